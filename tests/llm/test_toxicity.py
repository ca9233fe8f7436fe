import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from oddlog.llm import toxicity
from oddlog.llm.common import fold

BAD = ["scumbag", "idiotic", "vileness"]


def make(rng, toxic, words):
    text = ["".join(rng.choice(["an", "the", "re", "ou", "st"]) for _ in range(rng.randint(1, 4))) for _ in range(words)]
    if toxic:
        for _ in range(3):
            text.insert(rng.randrange(len(text) + 1), rng.choice([*BAD, "grolp" + rng.choice("abcdefghijk") * rng.randint(1, 4)]))
    return " ".join(text)


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(8)
    rows = [(i, make(rng, i % 6 == 0, rng.randint(5, 120)), int(i % 6 == 0)) for i in range(900)]
    both = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(3)
    return both.select("doc_id", "text"), both.select("doc_id", "toxic")


@pytest.fixture(scope="module")
def detector(tables):
    docs, labels = tables
    return toxicity.fit(docs.where(~fold(F.col("doc_id"), 3, 1)), labels.where(~fold(F.col("doc_id"), 3, 1)))


def slow_segments(x):
    """The best segment, then the same on either side of it."""
    out = []

    def search(a, b):
        best = None
        for i in range(a, b):
            total = 0.0
            for j in range(i, b):
                total += x[j]
                if total > 0 and (best is None or total > best[0] + 1e-12):
                    best = (total, i, j + 1)
        if best:
            search(a, best[1])
            out.append(best)
            search(best[2], b)

    search(0, len(x))
    return out


def test_all_maximal_segments():
    rng = random.Random(3)
    for _ in range(800):
        x = np.array([rng.choice([-3, -2, -1, 1, 2, 4]) + rng.random() / 100 for _ in range(rng.randint(0, 13))])
        assert [s[1:] for s in toxicity.segments(x)] == [s[1:] for s in slow_segments(x)]


def test_scan_is_linear_on_falling_sums():
    x = np.tile([1.0, -1.5], 200_000)
    assert len(toxicity.segments(x)) == 200_000


def test_root_of():
    values, weights = np.array([-1.0, 1.0]), np.array([3.0, 1.0])
    assert toxicity.root_of(values, weights) == pytest.approx(np.log(3), abs=1e-6)
    assert toxicity.root_of(np.array([-1.0]), np.array([1.0])) == 1.0


def test_held_out(tables, detector):
    docs, labels = tables
    scored = docs.join(labels, "doc_id").where(fold(F.col("doc_id"), 3, 1))
    found = scored.select("toxic", toxicity.probability(docs, detector, F.col("text")).alias("score")).collect()
    wrong = sum((r.score >= toxicity.LIMIT) != bool(r.toxic) for r in found)
    assert len(found) > 200 and wrong <= len(found) * 0.03


def test_unseen_words_are_scored_by_their_beginning(detector):
    assert detector.odds.score("grolpzzzz")[0] > 1 and detector.odds.score("neverseen")[0] == pytest.approx(-toxicity.DRIFT)


def test_passages(detector, tables, spark):
    text = "the an stre. You scumbag IDIOTIC vileness, an the re ou st"
    (start, end, worth), = detector.passages(text)
    assert text[start:end] == "scumbag IDIOTIC vileness" and worth > 0
    docs = spark.createDataFrame([(text,), (None,), ("an the",)], "text string")
    rows = docs.select(toxicity.passages(docs, detector, F.col("text")).alias("p")).collect()
    assert [len(r.p) for r in rows] == [1, 0, 0] and rows[0].p[0].start == start


def test_edge_rows(spark, detector, tables):
    docs, labels = tables
    rows = [(1, None), (None, ""), (2, "scumbag"), (2, "scumbag"), (3, "an the " * 50_000 + "scumbag idiotic vileness")]
    odd = spark.createDataFrame(rows, "doc_id long, text string").withColumn("toxic", F.lit("own"))
    got = odd.select("*", toxicity.probability(odd, detector, F.col("text")).alias("score")).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got) and {r.toxic for r in got} == {"own"}
    low = {r.score for r in got if not r.text}
    assert len(low) == 1 and next(r.score for r in got if r.doc_id == 3) > max(low)
    nulls = labels.union(spark.createDataFrame([(None, 1), (5, None), (7, 9)], "doc_id long, toxic int"))
    assert toxicity.fit(docs, nulls).odds.toxic > 1
    none = toxicity.fit(docs, labels.limit(0))
    assert none.probability(none.evidence("scumbag")) < 0.01
    assert toxicity.fit(docs, labels.where("toxic = 1")).probability(0.0) > 0.99
    assert odd.limit(0).select(toxicity.probability(odd, detector, F.col("text"))).count() == 0


def test_a_passage_is_found_again_where_its_words_are_repeated(detector):
    calm = "the an stre re ou st " * 30
    once, twice = calm + "scumbag idiotic vileness", calm + "scumbag idiotic vileness " + calm + "scumbag idiotic vileness"
    assert len(detector.passages(once)) == 1 and len(detector.passages(twice)) == 2
    spread = "scumbag " + calm + "idiotic " + calm + "vileness " + calm + "scumbag idiotic vileness"
    assert any(spread[a:b] == "scumbag idiotic vileness" for a, b, _ in detector.passages(spread))
    assert detector.evidence(twice) > detector.evidence(once)


def test_repeats_never_lower_the_evidence():
    odds = toxicity.LogOdds({"scum": (1, 90), "filth": (2, 80)}, 1000, 1000)
    detector = toxicity.Detector(odds, 1.0, 0.05)  # each word is a passage by itself
    for word in ("scum", "filth"):
        found = [detector.evidence(" ".join([word] * n)) for n in (1, 2, 3, 5, 20, 31, 32, 33, 64, 100, 1000)]
        assert found[0] > 0 and found == sorted(found)
    scores, fresh = odds.scores(["scum"] * 4)
    assert scores.tolist() == pytest.approx([odds.score("scum")[0] * toxicity.DAMP**k for k in range(4)]) and fresh == 1
    scores, fresh = odds.scores([*["calm"] * 3, *map(str, range(toxicity.NEAR)), "calm", "scum"])
    assert scores[:-1].tolist() == pytest.approx([-toxicity.DRIFT] * (toxicity.NEAR + 4)) and fresh == toxicity.NEAR + 3
