"""A selection of the registered queries against DuckDB; ALL_QUERIES=1 runs every one."""

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
FOLDER = "/root/testdata/sf0.01"
sys.path.insert(0, os.path.join(ROOT, "tools"))

pytest.importorskip("duckdb")
if not os.path.isdir(FOLDER):
    pytest.skip("no test tables", allow_module_level=True)

import check_queries  # noqa: E402

import __spark_entry__ as entry  # noqa: E402

SHORT = ["collect_returning_id", "paged_read_all", "request_scoring", "value_count_order", "detect_batch", "feature_matrix", "incremental_merge", "numeric_profile", "schema_union", "synthetic_events", "top_features"]
NAMES = list(entry.queries()) if os.environ.get("ALL_QUERIES") else SHORT


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    ok, message = check_queries.compare(name, entry.queries()[name], entry.oracle_sql().get(name), spark, FOLDER)
    assert ok, message


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 1000 and sum(r.explanation is not None for r in rows) == 600


@pytest.mark.parametrize("name", ["detect_batch", "feature_deviations", "request_scoring"])
def test_scoring_equals_sql_on_the_smallest_tables(spark, name):
    ok, message = check_queries.compare(name, entry.queries()[name], entry.oracle_sql()[name], spark, entry.SMOKE_DIR)
    assert ok, message


def test_a_log_type_with_fewer_features_has_no_cells_beyond_them(spark, tmp_path):
    """Six copies of the events: the few extreme ones are enough for a model, of a feature less than the others."""
    folder, copies = str(tmp_path), spark.range(6).withColumnRenamed("id", "copy")
    events = spark.read.parquet("/root/testdata/sf0.1/events.parquet").where("value > 400 OR event_id % 100 = 0").crossJoin(copies)
    shifted = events.withColumn("event_id", events["event_id"] + 100_000 * events["copy"]).drop("copy")
    for name in check_queries.TABLES:
        if name != "events":
            os.symlink(f"{FOLDER}/{name}.parquet", f"{folder}/{name}.parquet")
    shifted.write.parquet(f"{folder}/parts")
    import duckdb

    duckdb.connect().execute(f"COPY (FROM '{folder}/parts/*.parquet') TO '{folder}/events.parquet' (FORMAT parquet)")
    ok, message = check_queries.compare("feature_matrix", entry.queries()["feature_matrix"], entry.oracle_sql()["feature_matrix"], spark, folder)
    assert ok, message


def test_remembered_models_follow_the_data(spark, tmp_path):
    from oddlog.plans.catalog.registry import remembered, table

    built = []

    @remembered("events")
    def largest(session, folder):
        built.append(folder)
        return table(session, folder, "events").selectExpr("max(id)").first()[0]

    folder = str(tmp_path)
    spark.range(5).write.parquet(f"{folder}/events.parquet")
    assert [largest(spark, folder), largest(spark, folder)] == [4, 4] and len(built) == 1
    spark.range(9).write.mode("overwrite").parquet(f"{folder}/events.parquet")
    assert largest(spark, folder) == 8 and len(built) == 2


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["stats_join", "feature_deviations"])
def test_the_deviations_of_an_event_are_built_once(spark, name):
    """No filter by the size of the array, which holds all that builds it a second time."""
    plan = entry.queries()[name](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate inline" in plan
    assert not [line for line in plan.splitlines() if "Filter" in line and "size(" in line]
