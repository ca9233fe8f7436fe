import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from oddlog.llm import mixing

TARGETS = {"source": {"a": 0.5, "b": 0.3}, "lang": 0.5, "topic": 1}


@pytest.fixture(scope="module")
def docs(spark):
    text = F.concat(F.repeat(F.lit("word "), (F.col("id") % 9).cast("int")), F.when(F.col("id") % 4 == 0, "All rights reserved").otherwise(""))
    return spark.range(6000).select(
        F.col("id").alias("doc_id"),
        text.alias("text"),
        F.when(F.col("id") % 3 > 0, "a").when(F.col("id") % 2 == 0, "b").otherwise("c").alias("source"),
        F.when(F.col("id") % 10 < 7, "en").otherwise("fr").alias("lang"),
    )


def shares(rows, dim):
    weight = F.col("mixing.tokens") * F.col("mixing.weight")
    total = rows.agg(F.sum(weight)).first()[0]
    return {r[dim]: r.n / total for r in rows.groupBy(f"mixing.{dim}").agg(F.sum(weight).alias("n")).collect()}


def test_raked_cells_meet_all_marginals(spark):
    cells = spark.createDataFrame([(s, x, t, float(n)) for s, x, t, n in [("a", "en", "p", 900), ("a", "fr", "p", 30), ("b", "en", "q", 50), ("b", "fr", "p", 20), ("c", "en", "q", 0)]], "source string, lang string, topic string, tokens double")
    raked = mixing.rake(cells, {"source": {"a": 0.4, "b": 0.6}, "lang": 0.0, "topic": {"p": 0.7, "q": 0.3}}, 60).withColumn("w", F.col("factor") * F.col("tokens"))
    for dim, want in (("source", {"a": 0.4, "b": 0.6, "c": 0.0}), ("lang", {"en": 0.5, "fr": 0.5}), ("topic", {"p": 0.7, "q": 0.3})):
        got = {r[dim]: r.w / 1000 for r in raked.groupBy(dim).agg(F.sum("w").alias("w")).collect()}
        assert got == pytest.approx(want, abs=1e-3)


def test_drawn_documents_are_weighted_to_the_targets(docs):
    kept = mixing.mix(docs, TARGETS, rate=0.6, sweeps=30)
    assert set(kept.columns) == {*docs.columns, "mixing"}
    chance = kept.select("mixing.probability").distinct().collect()
    assert all(0 < r.probability <= 1 for r in chance) and 1500 < kept.count() < 5000
    got = shares(kept, "source")
    assert got["a"] == pytest.approx(0.5, abs=0.05) and got["b"] == pytest.approx(0.3, abs=0.05)
    again = mixing.mix(docs.repartition(7), TARGETS, rate=0.6, sweeps=30)
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {r.doc_id for r in again.select("doc_id").collect()}


def test_edge_rows(spark, docs):
    rows = [(1, None, None, None), (None, "", "a", "en"), (None, "x y", "a", "en"), (2, "a b c", "b", None), (2, "a b c", "b", None)]
    odd = spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id long, text string, source string, lang string, factor int, cell string")
    kept = mixing.mix(odd, {"source": 1, "lang": 1, "topic": 1}, rate=1.0)
    assert kept.count() == len(rows) and {r.factor for r in kept.collect()} == {1}
    assert {r.mixing.lang for r in kept.collect()} == {"en", mixing.NONE}
    assert mixing.mix(odd.limit(0)).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(odd.drop("lang"))
    many = mixing.mix(docs, TARGETS, rate=0.6)
    few, mixing.FEW = mixing.FEW, 1
    try:
        assert mixing.mix(docs, TARGETS, rate=0.6).count() == many.count()
    finally:
        mixing.FEW = few


def test_no_python_in_the_plan(docs):
    plan = mixing.mix(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_rows_of_the_pipeline_meet_the_targets_without_weights(spark):
    number = F.col("id")
    text = F.concat(F.repeat(F.lit("word "), (5 + number % 9).cast("int")), F.when(number % 23 == 0, "Copyright").otherwise(""))
    rows = spark.range(40_000).select(
        number.alias("doc_id"),
        text.alias("text"),
        F.when(number % 7 > 0, "a").otherwise("b").alias("source"),
        F.when(number % 25 > 0, "en").otherwise("es").alias("lang"),
    )
    kept = corpus_pipeline.mixed(spark, rows, "")
    assert kept.columns == rows.columns
    whole, drawn = (df.withColumn("topic", mixing.topic(F.col("text"))).withColumn("n", mixing.tokens(F.col("text"))) for df in (rows, kept))
    for dim, power in mixing.TARGETS.items():
        present = {r[dim]: float(r.n) for r in whole.groupBy(dim).agg(F.sum("n").alias("n")).collect()}
        got = {r[dim]: float(r.n) for r in drawn.groupBy(dim).agg(F.sum("n").alias("n")).collect()}
        wanted = {k: v**power / sum(x**power for x in present.values()) for k, v in present.items()}
        assert {k: v / sum(got.values()) for k, v in got.items()} == pytest.approx(wanted, abs=0.025)


def test_one_tiny_cell_does_not_decide_how_much_is_kept(spark):
    rows = spark.range(2000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 10).alias("text"), F.lit("a").alias("source"), F.lit("en").alias("lang"))
    rows = rows.union(spark.createDataFrame([(9999, "just three words", "b", "en")], rows.schema))
    kept = mixing.mix(rows, rate=None)
    assert kept.count() > 1900 and kept.where("source = 'b'").count() == 1


def test_raking_within_what_there_is(spark):
    """Against a plain version: no cell above its tokens, values with enough tokens meet their goals at the chosen rate."""
    rows = [(s, x, t, float((7 * i * i) % 97 + 1) * w) for i, (s, w) in enumerate([("a", 100), ("b", 30), ("c", 4), ("d", 1)]) for x in ("en", "es", "fr") for t in ("p", "q")]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens double")
    total = sum(r[3] for r in rows)
    found = mixing.rake_within(cells, mixing.TARGETS, few=True).collect()
    assert all(0 <= r.factor <= 1 for r in found) and len(found) == len(rows)
    kept = sum(r.factor * r.tokens for r in found)
    rate = next(r for r in mixing.RATES if kept <= r * total * (1 + 1e-9))
    for at, (dim, power) in enumerate(mixing.TARGETS.items()):
        has = {v: sum(r[3] for r in rows if r[at] == v) for v in {r[at] for r in rows}}
        whole = sum(n**power for n in has.values())
        for v, n in has.items():
            goal = rate * total * n**power / whole
            got = sum(r.factor * r.tokens for r in found if r[dim] == v)
            assert got == pytest.approx(min(n, goal), rel=0.03), (dim, v)
    few, many = (mixing.rake_within(cells, mixing.TARGETS, sweeps=2, few=way).collect() for way in (True, False))
    assert {r[:3]: pytest.approx(r.factor) for r in many} == {r[:3]: r.factor for r in few}

