import numpy as np
import pytest

from oddlog.operators import dayprofile, profile
from oddlog.session import new_path

SHARES = {f"p{s}": s / 100 for s in (0, 1, 10, 25, 50, 75, 90, 99, 100)}


def log(spark, days=6, rows=3000):
    return spark.sql(
        f"SELECT if(id % 7 < 5, 'hot', 'cold') AS log_type, date_add(date'2024-03-01', cast(id % {days} AS int)) AS day,"
        " 1e9 + pow(hash(id) / 2147483648D, 3) * 100 AS amount, id % 700 AS whole,"
        " if(id % 5 = 0, null, concat('u', id % 450)) AS `user.name`, id % 2 = 0 AS flag,"
        f" if(id % 4 = 0, double('NaN'), double(id % 9)) AS gaps, cast(null AS double) AS nothing FROM range({rows * days})"
    )


def test_days_together_equal_one_profile(spark):
    df = log(spark)
    path = new_path(spark, "t-days")
    dayprofile.refresh(df, path, ["log_type"], "day")
    whole = {(r.log_type, r.feature): r for r in profile.summarise(df.drop("day"), ["log_type"]).collect()}
    assert dayprofile.stored(spark, path).count() == 6 * 2 * 6
    got = dayprofile.merge_days(dayprofile.stored(spark, path), ["log_type"], SHARES).collect()
    assert len(got) == len(whole) == 12
    data = df.toPandas()
    for r in got:
        w = whole[r.log_type, r.feature]
        assert (r.position, r.kind, r.rows, r.non_null, r["min"], r["max"]) == (w.position, w.kind, w.rows, w.non_null, w["min"], w["max"])
        for name in ("mean", "variance", "std", "std_pop"):
            assert r[name] == pytest.approx(w[name], rel=1e-9) if w[name] is not None else r[name] is None, (r.feature, name)
        values = data[data.log_type == r.log_type][r.feature].dropna()
        assert abs(r.approx_distinct - values.nunique()) <= 0.08 * values.nunique()
        if r.kind == "text" or not len(values):
            assert all(r[s] is None for s in SHARES)
            continue
        values = np.sort(values.astype(float))
        for name, share in SHARES.items():
            below, upto = np.searchsorted(values, r[name]) / len(values), np.searchsorted(values, r[name], "right") / len(values)
            assert below - dayprofile.RANK_ERROR <= share <= upto + dayprofile.RANK_ERROR, (r.feature, name)


def test_a_new_day_is_read_alone_and_replaced_whole(spark):
    path, source = new_path(spark, "t-days"), new_path(spark, "t-log")
    log(spark, days=4, rows=100).withColumnRenamed("user.name", "user").write.partitionBy("day").parquet(source)
    table = spark.read.parquet(source)
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    seen = table.where("day = date'2024-03-04'").mapInArrow(counted, table.schema)
    dayprofile.refresh(table, path, ["log_type"], "day", ["2024-03-01", "2024-03-02", "2024-03-03"])
    assert {str(r[0]) for r in dayprofile.stored(spark, path).select("profile_day").distinct().collect()} == {f"2024-03-0{d}" for d in (1, 2, 3)}
    old = set(dayprofile.stored(spark, path).inputFiles())
    for _ in range(2):
        dayprofile.refresh(seen, path, ["log_type"], "day", ["2024-03-04"])
    assert read.value == 200 and old <= set(dayprofile.stored(spark, path).inputFiles())
    one = dayprofile.day_profiles(table.where("day IN (date'2024-03-04')"), ["log_type"], "day")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan
    merged = dayprofile.merge_days(dayprofile.stored(spark, path), ["log_type"])
    assert merged.where("feature = 'whole'").selectExpr("sum(rows)").first()[0] == 400
    part = dayprofile.merge_days(dayprofile.stored(spark, path, "2024-03-02", "2024-03-03"), [])
    assert part.where("feature = 'flag'").first().rows == 200


def test_candidates_follow_from_stored_days(spark):
    df = log(spark)
    path = new_path(spark, "t-days")
    dayprofile.refresh(df, path, ["log_type"], "day")
    roles = profile.classify(dayprofile.merge_days(dayprofile.stored(spark, path), ["log_type"]))
    want = profile.classify(profile.summarise(df.drop("day"), ["log_type"]))
    names = ["log_type", "feature", "as_category", "as_numeric", "stats_type"]
    assert sorted(roles.select(*names).collect()) == sorted(want.select(*names).collect())


def test_no_rows_and_no_days(spark):
    df = log(spark, days=2, rows=5)
    path = new_path(spark, "t-days")
    dayprofile.refresh(df, path, [], "day")
    dayprofile.refresh(df, path, [], "day", [])
    dayprofile.refresh(df.limit(0), path, [], "day")
    merged = dayprofile.merge_days(dayprofile.stored(spark, path), [], SHARES)
    assert merged.count() == 7 and merged.where("feature = 'whole'").first().rows == 10
    assert dayprofile.merge_days(dayprofile.stored(spark, path, "2025-01-01"), [], SHARES).count() == 0
    with pytest.raises(ValueError):
        dayprofile.day_profiles(df.select("day"), [], "day")
