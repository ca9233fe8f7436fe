import numpy as np
import pandas as pd
import pytest

from oddlog.operators.profile import categorical_stats, profile, summarise, value_counts

BY = ["log_type"]


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(3)
    n = 600
    frame = pd.DataFrame(
        {
            "log_type": rng.choice(["a", "b"], n, p=[0.7, 0.3]),
            "bytes": rng.exponential(100, n),
            "steady": 5.0,
            "small": rng.normal(0, 0.05, n),
            "src_port": rng.choice([22, 80, 443], n).astype(float),
            "ok": rng.random(n) < 0.5,
            "maybe": rng.choice([True, False, None], n),
            "action": rng.choice(["get", "put", None], n, p=[0.6, 0.2, 0.2]),
            "ident": [f"id{i}" for i in range(n)],
            "empty": None,
        }
    )
    frame.loc[frame.index % 7 == 0, "src_port"] = np.nan
    frame.loc[frame.index % 5 == 0, "bytes"] = np.nan
    return frame


SCHEMA = (
    "log_type string, bytes double, steady double, small double, src_port double, ok boolean, maybe boolean,"
    " action string, ident string, empty string"
)


@pytest.fixture(scope="module")
def logs(spark, sample):
    rows = [tuple(None if pd.isna(v) else v for v in r) for r in sample.itertuples(index=False)]
    return spark.createDataFrame(rows, SCHEMA)


def test_numeric_statistics_match_pandas(logs, sample):
    found = profile(logs, BY).features.where("feature = 'bytes'").collect()
    for row in found:
        values = sample.loc[sample.log_type == row.log_type, "bytes"]
        want = [values.mean(), values.std(), values.min(), values.max(), values.median(), values.quantile(0.25), values.quantile(0.75)]
        assert [row[k] for k in ("mean", "std", "min", "max", "median", "q25", "q75")] == pytest.approx(want)
    assert len(found) == 2


def test_candidates_and_types(logs):
    rows = {(r.log_type, r.feature): r for r in profile(logs, BY, max_cardinality=50).features.collect()}
    names = {f for _, f in rows}
    assert names == {"bytes", "src_port", "ok", "maybe", "action"}  # no constants, ids, low variance or empty columns
    assert rows["a", "src_port"].is_category and rows["a", "src_port"].type == "numerical"
    assert not rows["a", "ok"].is_category and rows["a", "ok"].type == "categorical"
    assert rows["a", "maybe"].is_category and rows["a", "maybe"].unique_count == 2


def test_value_counts_use_one_text_form(logs, sample):
    counts = {(r.feature, r.value): r.cnt for r in value_counts(logs, [], ["ok", "src_port", "action"]).collect()}
    assert counts["ok", "True"] == int(sample.ok.sum())
    assert counts["src_port", "443"] == int((sample.src_port == 443).sum())
    assert {v for f, v in counts if f == "action"} == {"get", "put"}


def test_ties_go_to_the_smallest_value(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), ("c",)], "x string")
    row = categorical_stats(value_counts(df, [], ["x"]), []).first()
    assert (row.unique_count, row.total, row.most_common, row.most_common_freq) == (3, 5, "a", 2)


def test_wide_tables_are_summarised_in_blocks(spark):
    df = spark.range(50).selectExpr("'t' AS log_type", *[f"id * {i} AS n{i}" for i in range(130)], *[f"concat('v', id % {i + 2}) AS s{i}" for i in range(70)])
    rows = {r.feature: r for r in summarise(df, BY).collect()}
    assert len(rows) == 200
    assert rows["n129"].mean == pytest.approx(129 * 24.5)
    assert rows["s3"].approx_distinct == 5


def test_many_distinct_values_are_never_counted(spark):
    df = spark.range(6000).selectExpr("'t' AS log_type", "concat('id', id) AS ident", "concat('g', id % 4) AS grp")
    found = profile(df, BY)
    assert [r.feature for r in found.features.collect()] == ["grp"]
    assert {r.feature for r in found.counts.collect()} == {"grp"}
