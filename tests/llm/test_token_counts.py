import random

import public_tokenizers
import pytest

from oddlog.llm import token_counts
from oddlog.session import new_path

sentencepiece = pytest.importorskip("sentencepiece")
PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    with open(PATH, "rb") as file:
        return file.read()


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


TEXTS = ["", " ", "a  b", "  a", "a b ", "▁a ▁b", "a\n b\n\n c\t", "<s> x </s> <unk>", "\xa0a　b", "ﬁ①", "x\x00y", "é" * 300, "\U0001f600", "a ", "a▁", "a  "]


def test_word_counts_equal_the_library(model, library):
    counter = token_counts.Counter(model)
    assert counter.by_word
    rng = random.Random(6)
    letters = "ab cd  ef▁é日\n\t.,<s>0"
    texts = TEXTS + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    want = [len(library.encode(t)) for t in texts]
    assert counter.count(texts) == want
    counter.by_word = False
    assert counter.count(texts) == want


def test_memo_is_bounded(model, library, monkeypatch):
    monkeypatch.setattr(token_counts, "ROOM", 10)
    counter = token_counts.Counter(model)
    texts = [" ".join(f"w{i}{j}" for j in range(8)) for i in range(20)]
    assert [counter.count([t])[0] for t in texts] == [len(library.encode(t)) for t in texts]
    assert len(counter.known) <= 16


def test_only_distinct_misses_are_encoded(spark, model, library):
    path = new_path(spark, "t-tokens")
    first = spark.createDataFrame([(i, f"text {i % 5}") for i in range(20)], "doc_id long, text string")
    assert token_counts.count_tokens(first, PATH, path).count() == 20
    assert token_counts.read_cache(spark, path).count() == 5
    more = first.union(spark.createDataFrame([(90, "text 3"), (91, "a new one"), (92, "▁a new one"), (93, " a new one")], first.schema))
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(more, PATH, path).collect()}
    assert token_counts.read_cache(spark, path).count() == 7  # the last two have one normalised content
    assert all(got[r.doc_id] == len(library.encode(r.text)) for r in more.collect())
    other = token_counts.version(model + b"x")
    assert other != token_counts.version(model)


def test_stored_counts_are_used_and_versions_kept_apart(spark, model):
    path = new_path(spark, "t-tokens")
    docs = spark.createDataFrame([(1, "one text")], "doc_id long, text string")
    digest = docs.select(token_counts.digest(docs.text)).first()[0]
    rows = [(token_counts.version(model), bytes(digest), 77), ("other tokenizer", bytes(digest), 5)]
    spark.createDataFrame(rows, token_counts.SCHEMA).write.parquet(path)
    assert token_counts.count_tokens(docs, PATH, path).first().n_tokens == 77


def test_edge_rows(spark, library):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, None, "x"), (3, TEXTS[3], None), (99, "long text " * 100_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string")
    got = token_counts.count_tokens(docs, PATH).collect()
    want = [(i, len((t or "").encode()), len(library.encode(t or ""))) for i, t, _ in rows]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert token_counts.count_tokens(docs.limit(0), PATH).count() == 0
