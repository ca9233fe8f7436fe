import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from oddlog.functions.scoring import average_path
from oddlog.operators import forest


def walk(nodes, row):
    """One tree, one row, node by node."""
    node = 1
    while nodes[node][0] is not None:
        feature, threshold, _ = nodes[node]
        node = 2 * node + (1 if row[feature] > threshold else 0)
    return nodes[node][2]


def test_average_path():
    assert average_path(1) == 0 and average_path(2) == 1
    assert average_path(256) == pytest.approx(10.2447, abs=1e-3)


def test_vector_walk_equals_node_walk():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 4))
    x[:, 3] = 1.0
    trees = pd.concat([forest.grow("t", i, x[rng.choice(300, size)]) for i, size in enumerate([256, 256, 100, 3, 1])])
    packed = forest.pack(trees, 4)["t"]
    got = forest.mean_path(packed, x)
    total = np.zeros(len(x))
    for _, rows in trees.groupby("tree"):
        nodes = {r.node: (None if pd.isna(r.feature) else int(r.feature), r.threshold, r.path_length) for r in rows.itertuples()}
        total += [walk(nodes, row) for row in x]
    assert got == pytest.approx(total / 5)
    assert set(trees["feature"].dropna()) <= {0, 1, 2}  # the constant column is never split


def test_tree_ignores_row_order():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(256, 3))
    a, b = forest.grow("t", 5, x), forest.grow("t", 5, x[rng.permutation(256)])
    pd.testing.assert_frame_equal(a, b)
    assert not forest.grow("t", 6, x).equals(a)


def test_draw_plan_uses_one_hash_on_large_tables():
    (_, p, per_draw, draws), = forest.draw_plan({"big": 10_000_000})
    assert (per_draw, draws) == (100, 1) and p * 10_000_000 > 256
    (_, p, per_draw, draws), = forest.draw_plan({"small": 200})
    assert (p, per_draw, draws) == (1.0, 1, 100)


@pytest.mark.parametrize("n", [50, 300, 5000, 60000])
def test_every_tree_gets_distinct_rows(spark, n):
    df = spark.range(n).select(F.lit("t").alias("log_type"), F.col("id"))
    rows = forest.draw_samples(df, {"t": n}, ["id"]).groupBy("_tree").agg(
        F.count("id").alias("n"), F.countDistinct("id").alias("d")
    ).collect()
    assert len(rows) == 100
    assert {(r.n, r.d) for r in rows} == {(min(256, n), min(256, n))}


def test_draw_does_not_depend_on_partitioning(spark):
    df = spark.range(20000).select(F.lit("t").alias("log_type"), F.col("id"), F.rand(5).alias("x"))
    trees = [
        forest.fit_forest(forest.draw_samples(part, {"t": 20000}, ["id"]), ["x"]).orderBy("tree", "node").toPandas()
        for part in (df, df.orderBy(F.desc("id")).repartition(7))
    ]
    pd.testing.assert_frame_equal(*trees)


def test_copies_of_one_row_neither_fill_nor_starve_the_sample(spark):
    """A third of all rows are the same event; without a key every copy is drawn on its own."""
    n = 30000
    df = spark.range(n).select(
        F.lit("t").alias("log_type"), F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("x")
    )
    rows = forest.draw_samples(df, {"t": n}, None).groupBy("_tree").agg(
        F.count("x").alias("n"), F.avg((F.col("x") == -1).cast("double")).alias("share")
    ).collect()
    assert len(rows) == 100 and {r.n for r in rows} == {256}
    assert np.mean([r.share for r in rows]) == pytest.approx(1 / 3, abs=0.02)


def test_offset_is_the_tenth_percentile(spark):
    rng = np.random.default_rng(4)
    values = -rng.random(4321)
    df = spark.createDataFrame(pd.DataFrame({"log_type": "t", "score": values}))
    offsets = forest.score_offsets(df)
    assert offsets.first().offset == pytest.approx(np.percentile(values, 10))
    assert forest.anomaly_rates(df, offsets).first().anomaly_rate == pytest.approx(0.1, abs=0.001)
