import hashlib

import pytest
from pyspark.sql import functions as F

from oddlog.llm import fingerprints


def vectors(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return [r.v for r in df.select("i", fingerprints.vector(F.col("text")).alias("v")).orderBy("i").collect()]


def test_sum_of_paragraphs(spark):
    a, b, ab, ba, aab, none, empty = vectors(spark, "One here. ", "Two.\n", "One here. Two.\n", "Two.\nOne here. ", "One here. One here. Two.\n", None, "")
    assert ab == ba == [x + y for x, y in zip(a, b)] and ab != aab
    assert none == empty == [0] * fingerprints.LANES
    df = spark.createDataFrame([(aab, a)], "x array<long>, y array<long>")
    less = df.select(fingerprints.without(F.col("x"), F.col("y")), fingerprints.combined(F.col("x"), F.col("y"))).first()
    assert less[0] == ab and less[1] == vectors(spark, "One here. " * 3 + "Two.\n")[0]


def test_wraps_around(spark):
    top = (1 << 31) - 1
    df = spark.createDataFrame([([top, -top - 1], [1, -1])], "x array<long>, y array<long>")
    assert df.select(fingerprints.combined(F.col("x"), F.col("y"))).first()[0] == [-top - 1, top]
    assert df.select(fingerprints.shown(F.col("y"))).first()[0] == "00000001ffffffff"


def test_paragraphs_keep_every_character(spark):
    text = "A b. C!  d?\n\ne.f\tg.\n h"
    df = spark.createDataFrame([(text,)], "t string")
    parts = df.select(fingerprints.paragraphs(F.col("t"))).first()[0]
    assert "".join(parts) == text and len(parts) > 4


@pytest.mark.parametrize("spread", ["dense", "uneven", "repeated"])
def test_next_row_by_id(spark, monkeypatch, spread):
    monkeypatch.setattr(fingerprints, "NEIGHBOURS", 3)
    ids = {"dense": range(3, 4003, 7), "uneven": [i**4 for i in range(500)], "repeated": [i // 2 for i in range(400)] + [None, None]}[spread]
    texts = [f"Text {i * 7919 % 613}. " * (i % 5) + "é" * (i % 3) for i in range(len(ids))]
    rows = list(zip(ids, texts))
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, place string").repartition(5)
    got = sorted(tuple(r[:3]) for r in fingerprints.with_next(df).select(F.coalesce("doc_id", F.lit(-1)), "n_chars", "edited_sha256").collect())
    rows.sort(key=lambda r: (-1 if r[0] is None else r[0], r[1]))
    want = []
    for (i, text), (_, follower) in zip(rows, rows[1:] + rows[:1]):
        quarter = len(text) // 4
        edited = text[: len(text) - quarter] + follower[:quarter]
        want.append((-1 if i is None else i, len(text), hashlib.sha256(edited.encode()).hexdigest()))
    assert got == sorted(want)


def test_likeness(spark):
    base = "".join(f"Sentence number {i} is here. " for i in range(80))
    other = "".join(f"Another thing {i} altogether. " for i in range(80))
    df = spark.createDataFrame([(1, base), (2, other), (3, None), (4, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in fingerprints.with_next(df).collect()}
    assert got[1].near_edited > 0.5 > abs(got[1].near_next) and got[2].near_next == 0.0
    assert got[3].near_next == got[3].near_edited == 1.0 and got[4].near_next == 0.0


def test_small_tables(spark):
    df = spark.createDataFrame([(9, "Only one. Text")], "doc_id long, text string")
    row = fingerprints.with_next(df).first()
    assert row.near_next == 1.0 and row.n_chars == 14
    assert row.edited_sha256 == hashlib.sha256(b"Only one. TOnl"[:11] + b"Onl").hexdigest()
    assert fingerprints.with_next(df.limit(0)).count() == 0
    assert fingerprints.with_next(df.union(df)).count() == 2


def test_no_python_in_the_plan(spark):
    df = spark.range(50).selectExpr("id AS doc_id", "repeat('Ab c. ', 9) AS text")
    plan = fingerprints.with_next(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
