import numpy as np
import pytest
from pyspark.sql import functions as F

from oddlog.llm import pivot_search


def slow(vectors, k):
    sound = [(i, np.floor(64 * np.array(v, float))) for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max((len(x) for _, x in sound), default=0)
    sound = [(i, np.pad(x, (0, width - len(x)))) for i, x in sound]
    out = set()
    for q, x in {i: x for i, x in sound if i % 20 == 0}.items():
        ranked = sorted((-int(x @ y), i) for i, y in sound if i != q)[:k]
        out |= {(q, rank, i, -score) for rank, (score, i) in enumerate(ranked, 1)}
    return out


def clustered(n, seed, width=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, width))
    return [(i, (centres[rng.integers(8)] + 0.2 * rng.normal(size=width)).astype(np.float32).tolist()) for i in range(n)]


@pytest.mark.parametrize("block", [8192, 97])
def test_equals_all_scores(spark, monkeypatch, block):
    monkeypatch.setattr(pivot_search, "BLOCK", block)
    monkeypatch.setattr(pivot_search, "QUERY_BLOCK", 16)
    rows = clustered(400, 1)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = pivot_search.top_k(df, F.col("vec_id") % 20 == 0, 20)
    assert {tuple(r) for r in got.collect()} == slow(rows, 20)


def test_pivots_spare_most_scores_of_clustered_vectors():
    rng = np.random.default_rng(2)
    centres = 40 * rng.normal(size=(40, 8))
    rows = np.floor(64 * (centres[rng.integers(40, size=6000)] + 0.05 * rng.normal(size=(6000, 8))))
    ids = np.arange(6000)
    pivots = rows[rng.choice(6000, 64)]
    table = pivot_search.distances(rows, pivots)
    some = np.arange(0, 6000, 100)
    found, computed = pivot_search.search_block(rows[some], ids[some], table[some], rows, ids, table, 5)
    assert len(found[0]) == 5 * len(some) and computed < 0.9 * len(some) * len(rows)


def test_ties_and_edge_rows(spark):
    rows = [(i, [0.5, 0.25]) for i in range(0, 60)]
    rows += [(100, [1.0, None]), (120, None), (140, [float("nan"), 1.0]), (160, [float("inf"), 1.0]), (None, [9.0, 9.0])]
    rows += [(200, [0.1]), (220, [0.1, 0.2, 0.3]), (240, []), (61, [-0.5, -0.3])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, score string")
    got = pivot_search.top_k(df, F.col("vec_id") % 20 == 0, 20)
    assert {tuple(r) for r in got.collect()} == slow(rows, 20)
    twice = df.union(df)
    both = pivot_search.top_k(twice, F.col("vec_id") % 20 == 0, 3).where("query_id = 0").orderBy("rank").collect()
    assert [r.vec_id for r in both] == [220, 220, 1][: len(both)] or len(both) == 3
    assert pivot_search.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert pivot_search.top_k(df.where("vec_id = 0"), F.col("vec_id") % 20 == 0).count() == 0
