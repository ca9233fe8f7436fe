import hashlib
import pickle
import random

import pytest
import public_tokenizers
from pyspark.sql import functions as F

from oddlog.llm import byte_bpe

tiktoken = pytest.importorskip("tiktoken")
PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TEXTS = [
    "", " ", "  a\n\n b\t", "we've I'LL don't", "½ ²x ªº", "日本語　テスト １２３", "\x85a\x1cb c d", "a" * 3000,
    "\U0001f600‍ é́", "x" * 10 + " " * 50 + "y", "\x00\x01", "über Straße señor çà et là 1234567",
]


@pytest.fixture(scope="module")
def words():
    return pickle.loads(pickle.dumps(byte_bpe.vocabulary(PATH, public_tokenizers.PATTERN)))


@pytest.fixture(scope="module")
def library():
    ranks = byte_bpe.read_ranks(PATH)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoded(words, texts):
    ids, counts = words.encode(texts)
    out, at = [], 0
    for n in counts:
        out.append(ids[at : at + n].tolist())
        at += n
    return out


def test_perfect_hash_is_minimal(words):
    slots = words.hash.find(words.keys)
    assert sorted(slots.tolist()) == list(range(len(words.keys)))
    assert [words.hash.find_one(k) for k in words.keys[:500]] == slots[:500].tolist()
    assert (words.whole([b"no such token at all", b"\xff\xfe\xfd"]) == -1).all()


def test_ids_equal_the_library(words, library):
    rng = random.Random(5)
    letters = "abcdeéßñ 日'\n\t.,0² ЖЛ"
    texts = TEXTS + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(800)]
    assert encoded(words, texts) == [library.encode_ordinary(t) for t in texts]


def test_memo_may_be_forgotten(words, library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "ROOM", 5000)
    words.forget()
    texts = [" ".join([f"wort{i * 7 + j}x" for j in range(9)] + ["allezeit"]) for i in range(30)]
    merged = []
    merge = words.merge
    monkeypatch.setattr(words, "merge", lambda word: merged.append(word) or merge(word))
    found = [ids for text in texts for ids in encoded(words, [text])]
    assert found == [library.encode_ordinary(t) for t in texts]
    assert merged.count(b" allezeit") == 1  # what is used again stays through all turns
    assert len(words.memo) + len(words.last) < 80


def test_a_step_may_give_the_memo_less_room(words, library):
    texts = [f"{'x' * 50_000}{i}" for i in range(8)]
    words.forget()
    for text in texts:
        ids, _ = words.encode([text], room=100_000)
        assert ids.tolist() == library.encode_ordinary(text)
    assert sum(map(len, [*words.memo, *words.last])) < 300_000


def test_memo_is_bounded_in_bytes(words, library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "ROOM", 100_000)
    words.forget()
    texts = [f"{'x' * 50_000}{i}" for i in range(8)]
    assert encoded(words, texts[:1]) + [ids for t in texts[1:] for ids in encoded(words, [t])] == [library.encode_ordinary(t) for t in texts]
    assert sum(map(len, [*words.memo, *words.last])) < 300_000


def test_long_text_in_portions(words, library, monkeypatch):
    text = "Ein längerer Text, don't stop. " * 500
    monkeypatch.setattr(byte_bpe, "LONG", 100)
    assert encoded(words, [text]) == [library.encode_ordinary(text)]


def test_round_trip_and_edge_rows(spark, library):
    rows = [(i, t, "keep") for i, t in enumerate(TEXTS)] + [(None, None, None), (3, TEXTS[3], "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, decoded string")
    both = byte_bpe.decode(byte_bpe.encode(docs, PATH, public_tokenizers.PATTERN), PATH)
    got = both.select("text", "ids", "decoded", byte_bpe.ids_digest(F.col("ids")).alias("digest")).collect()
    assert len(got) == len(rows)
    for row in got:
        ids = library.encode_ordinary(row.text or "")
        assert row.ids == ids and bytes(row.decoded) == (row.text or "").encode()
        assert row.digest == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert byte_bpe.encode(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
