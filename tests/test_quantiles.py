import numpy as np
import pandas as pd
import pytest

from oddlog.operators import quantiles
from oddlog.operators.quantiles import exact_quantiles

PROBS = {"p00": 0.0, "p10": 0.1, "p25": 0.25, "p50": 0.5, "p99": 0.99, "p100": 1.0}


def cases():
    rng = np.random.default_rng(7)
    hot = np.concatenate([np.full(4000, 3.25), rng.normal(size=6000)])
    yield "normal", rng.normal(size=5001)
    yield "heavy tail", rng.pareto(0.3, size=5000) * 10.0 ** rng.integers(-12, 12, 5000)
    yield "both signs", -rng.lognormal(5, 6, 4000) * rng.choice([-1, 1], 4000)
    yield "hot value", hot
    yield "few values", rng.integers(0, 3, 1000).astype(float)
    yield "tiny differences", 1.0 + rng.integers(0, 50, 3000) * 2.0**-52
    yield "single", np.array([42.0])
    yield "two", np.array([1.0, 2.0])
    yield "extremes", np.array([-1.7e308, 0.0, 1.7e308, 5e-324, -5e-324])


@pytest.mark.parametrize("cell_rows", [quantiles.CELL_ROWS, 20], ids=["one round", "sliced again"])
@pytest.mark.parametrize("name, values", list(cases()), ids=[n for n, _ in cases()])
def test_matches_linear_interpolation(spark, monkeypatch, name, values, cell_rows):
    monkeypatch.setattr(quantiles, "CELL_ROWS", cell_rows)
    df = spark.createDataFrame(pd.DataFrame({"g": "a", "value": values})).repartition(5)
    got = exact_quantiles(df, ["g"], PROBS).first()
    ranked = np.sort(values)
    for key, p in PROBS.items():
        position = p * (len(values) - 1)
        low, high = ranked[int(np.floor(position))], ranked[int(np.ceil(position))]
        want = low if low == high else low + (high - low) * (position - np.floor(position))
        assert got[key] == pytest.approx(want, rel=1e-12, abs=1e-320), key


def test_groups_nulls_and_infinities(spark):
    rows = [("a", None), ("a", 1.0), ("a", float("nan")), ("a", 3.0), ("b", float("inf")), ("b", 2.0), ("b", float("-inf"))]
    df = spark.createDataFrame(rows + [("empty", None)], "g string, value double")
    got = {r.g: r.m for r in exact_quantiles(df, ["g"], {"m": 0.5}).collect()}
    assert got == {"a": 2.0, "b": 2.0}


def test_windows_only_see_chosen_cells(spark, monkeypatch):
    """A continuous field close to one value needs several rounds; the last window sees a handful of rows."""
    monkeypatch.setattr(quantiles, "CELL_ROWS", 50)
    sizes = []
    holding = quantiles._holding
    monkeypatch.setattr(quantiles, "_holding", lambda hist, *a: sizes.append(hist.count()) or holding(hist, *a))
    df = spark.range(100000).selectExpr("'a' AS g", "1.7e9 + id / 1e5 AS value")
    got = exact_quantiles(df, ["g"], {"m": 0.5}).first().m
    assert got == pytest.approx(1.7e9 + 49999.5 / 1e5, abs=1e-6)
    assert len(sizes) >= 3 and max(sizes[:-1]) <= quantiles.SLICES and sizes[-1] <= 100
