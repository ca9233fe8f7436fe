import pickle
import random
import tracemalloc

import pytest
from pyspark.sql import functions as F

from oddlog.llm import language
from oddlog.llm.common import fold

SOUNDS = {"aa": ["ba", "ku", "lo"], "bb": ["sch", "ich", "un"], "cc": ["tion", "eau", "ou"]}


def sentence(rng, lang, words):
    return " ".join("".join(rng.choice(SOUNDS[lang]) for _ in range(rng.randint(1, 4))) for _ in range(words))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    rows = []
    for i in range(400):
        lang = rng.choice(sorted(SOUNDS))
        rows.append((i, sentence(rng, lang, rng.randint(3, 40)), lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)


def test_held_out_accuracy(docs):
    held_out = fold(F.col("doc_id"), 4, 2)
    model = language.fit(docs.where(~held_out))
    found = docs.where(held_out).select("lang", language.identify(docs, model).alias("f")).collect()
    assert len(found) > 60 and all(r.lang == r.f.lang for r in found)
    assert all(0 <= r.f.score <= 1 for r in found)


def test_unseen_words_back_off_to_shorter_pieces(docs):
    model = language.fit(docs, words=5)
    assert len(model.words) == 5
    assert model.predict(["schichunsch", "Eautionou!", "kulobaku 12"])[0] == ["bb", "cc", "aa"]
    few = language.fit(docs, words=0, grams=12)
    assert not few.words and few.predict(["schschsch"])[0] == ["bb"]


def test_sample_is_bounded_and_repeatable(docs):
    one, two = (language.fit(docs.repartition(n), per_language=20) for n in (2, 5))
    whole = language.fit(docs)
    assert one.words.keys() == two.words.keys() and len(one.words) < len(whole.words)
    assert all((one.words[w] == two.words[w]).all() for w in one.words)


def test_edge_rows(spark, docs):
    model = language.fit(docs)
    rows = [(1, None, None), (None, "", "x"), (2, "12 ²½ ⅷ① 34", None), (2, "12 .,! 34", None), (3, "k" * 100_000, "aa"), (4, "Ω ж", "")]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("own"))
    got = odd.select("*", language.identify(odd, model).alias("f")).collect()
    assert len(got) == len(rows)
    assert [r.f.lang for r in got if r.doc_id in (1, None, 2)] == ["und"] * 4
    assert all(r.f.score == 0 for r in got if r.f.lang == "und") and {r.score for r in got} == {"own"}
    assert all(r.f.lang in SOUNDS for r in got if r.doc_id in (3, 4))
    nothing = language.fit(docs.limit(0))
    assert nothing.predict(["abc", ""]) == (["und", "und"], [0.0, 0.0])
    assert language.fit(odd.where("lang is null")).languages == []
    assert odd.limit(0).select(language.identify(odd, model)).count() == 0


def test_long_runs_are_read_whole_and_weigh_by_their_length(docs):
    model = language.fit(docs)
    middle = "aku" * 33 + "schichun" * 12_500 + "aku" * 33
    assert model.predict([middle])[0] == ["bb"]
    assert model.predict([middle + " bakulo loku kuba"])[0] == ["bb"]
    assert len(language.cut(["x" * 100_000])) > 5000 and language.cut(["x" * 200]) == ["x" * 200]
    pieces = language.cut(["".join(chr(97 + i % 26) for i in range(1000))])
    grams = {g for p in pieces for g in (p[i : i + 4] for i in range(len(p) - 3))}
    assert len(grams) == 26 and all(len(p) <= language.PIECE for p in pieces)


def test_predictions_equal_a_plain_version(docs):
    import math

    model = language.fit(docs, words=40, grams=60)
    rng = random.Random(9)
    texts = [sentence(rng, rng.choice(sorted(SOUNDS)), rng.randint(1, 15)) + rng.choice(["", " zz", " unknown 77"]) for _ in range(50)]

    def piece(gram, lang):
        known = model.pieces[len(gram) - 1].get(gram)
        if known is not None:
            return known[lang]
        return 0.0 if len(gram) == 1 else (piece(gram[:-1], lang) + piece(gram[1:], lang)) / 2

    for text, got, score in zip(texts, *model.predict(texts)):
        words = [w for w in text.split() if w.isalpha()]
        sums = []
        for lang in range(3):
            total = 0.0
            for w in words:
                marked = f"<{w}>"
                parts = [marked[i : i + 4] for i in range(max(1, len(marked) - 3))]
                total += model.words[w][lang] if w in model.words else sum(piece(p, lang) for p in parts) / len(parts)
            sums.append(total / len(words))
        want = max(range(3), key=lambda i: sums[i])
        assert got == model.languages[want]
        assert score == pytest.approx(1 / sum(math.exp((s - sums[want]) * min(len(words), 10)) for s in sums))


def test_a_workers_copy_of_the_model_is_small():
    rows = [(f"wort{i}", {"aa": i + 1, "cc": 1}) for i in range(20_000)]
    languages = ["aa", "bb", "cc", "dd"]
    rates = language.smoothed(rows, languages)
    sent = pickle.dumps(language.Model(languages, rates, [rates] * language.LONGEST))
    tracemalloc.start()
    got = pickle.loads(sent)
    held, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert held / len(rows) < 180  # numbers, text, place; not an array for each entry
    assert got.word("wort7").tolist() == rates["wort7"].tolist()
