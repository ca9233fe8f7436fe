import datetime as dt

import pytest
from pyspark.sql import functions as F

from oddlog.operators import merge, reports
from oddlog.plans.collect import LogQuery, collect_all, read_collected
from oddlog.session import new_path, stage, work_dir
from oddlog.sources import logs, state as states
from oddlog.streaming.score import dedupe_stream, read_events

AS_OF = "2024-02-01 00:00:00"
SCHEMA = "id string, alertId string, timestamp string, body string"


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def test_first_copy_wins_and_kinds_of_keys_do_not_mix(spark):
    old = frame(spark, ("1", None, "2024-01-31", "old"), (None, None, "2024-01-30", "by time"))
    new = frame(
        spark,
        ("1", None, "2024-01-31", "new"),
        ("2024-01-30", None, None, "an id that looks like a time"),
        ("", "", "2024-01-30", "empty ids fall through"),
        (None, None, None, "no key at all"),
        (None, None, None, "no key at all"),
    )
    got = {r.body for r in merge.merge_incremental(old, new, AS_OF, 30).collect()}
    assert got == {"old", "by time", "an id that looks like a time", "no key at all"}


def test_retention_keeps_unreadable_times(spark):
    old = frame(
        spark,
        ("1", None, "2024-01-31T23:00:00-05:00", "inside"),
        ("2", None, "2023-12-01T00:00:00Z", "expired"),
        ("3", None, "whenever", "unreadable"),
        ("4", None, None, "timeless"),
    )
    got = {r.body for r in merge.retain(old, AS_OF, 30).collect()}
    assert got == {"inside", "unreadable", "timeless"}


def test_retention_falls_back_to_later_fields(spark):
    df = spark.createDataFrame([("", "2023-01-01", "a"), (None, "2024-01-31", "b")], "timestamp string, createdAt string, body string")
    assert [r.body for r in merge.retain(df, dt.datetime(2024, 2, 1), 30).collect()] == ["b"]


def test_merge_is_idempotent(spark):
    old = frame(spark, *[(str(i), None, "2024-01-20", f"o{i}") for i in range(50)])
    new = frame(spark, *[(str(i), None, "2024-01-21", f"n{i}") for i in range(25, 75)])
    once = merge.merge_incremental(old, new, AS_OF, 30)
    twice = merge.merge_incremental(once, new, AS_OF, 30)
    assert once.count() == 75
    assert sorted(once.collect()) == sorted(twice.collect())
    unshuffled = merge.merge_incremental(once, new, AS_OF, 30, existing_unique=True)
    assert sorted(once.collect()) == sorted(unshuffled.collect())
    fresh = merge.unseen(old, new)
    assert sorted(r.id for r in fresh.collect()) == sorted(str(i) for i in range(50, 75))


def test_columns_of_one_side_only(spark):
    old = frame(spark, ("1", None, "2024-01-20", "o"))
    new = frame(spark, ("2", None, "2024-01-20", "n")).withColumn("extra", F.lit(5))
    rows = {r.id: r.extra for r in merge.merge_incremental(old, new, AS_OF, 30).collect()}
    assert rows == {"1": None, "2": 5}


def test_hot_key_is_limited_before_the_shuffle(spark):
    df = spark.range(30000).selectExpr("if(id % 3 = 0, 'hot', cast(id AS string)) AS id", "id AS seq")
    once = merge.keep_first(df, merge.identity(df), ["seq"])
    assert once.count() == 20001
    plan = once._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "Partial" in plan


def test_latest_timestamp(spark):
    df = frame(spark, ("1", None, "2024-01-20T00:00:00+02:00", "a"), ("2", None, "2024-01-19T23:00:00Z", "b"), ("3", None, "zzz", "c"))
    assert merge.latest_timestamp(df, [], AS_OF).first().latest_timestamp == "2024-01-19T23:00:00Z"
    none = frame(spark, ("1", None, None, "a"))
    assert merge.latest_timestamp(none, [], AS_OF).first().latest_timestamp == "2024-02-01T00:00:00Z"


def test_density(spark):
    rows = [("a", i, f"2024-01-{1 + i // 100:02d}T00:00:00Z") for i in range(2000)] + [("b", 1, "2024-01-01"), ("c", 1, None), ("c", 2, "?")]
    df = spark.createDataFrame(rows, "title string, seq int, timestamp string")
    got = {r.title: r for r in merge.density(df, ["title"], 30, [F.col("seq")]).collect()}
    # the last 1000 rows lie in days 11 to 20: 1000 / 9 per day over 30 days
    assert got["a"].estimated_total == 3333 and got["a"].progress_pct == pytest.approx(60.006, abs=1e-3)
    assert got["a"].time_range == "01/11 00:00 to 01/20 00:00"
    for title, count in (("b", 1), ("c", 2)):
        assert (got[title].estimated_total, got[title].progress_pct) == (2 * count, 50.0)


def test_state_table(spark, tmp_path):
    start = states.initial(spark.createDataFrame([("x", 30), ("a", 14)], "title string, window_days int"), "2024-01-01T00:00:00")
    runs = spark.createDataFrame([("x", "2024-01-31T00:00:00Z", 7)], "title string, latest_timestamp string, n_logs bigint")
    after = states.upsert(start, states.after_run(start, runs, AS_OF))
    path = str(tmp_path / "state")
    states.save(after, path)
    states.save(states.load(spark, path), path)  # reading and replacing the same table
    loaded = states.load(spark, path)
    assert [r.title for r in states.titles(loaded).collect()] == ["a", "x"]
    row = states.get(loaded, "x").first()
    assert (row.record_count, row.created_at, row.updated_at) == (7, "2024-01-01T00:00:00Z", "2024-02-01T00:00:00Z")
    days = {r.title: r.next_days for r in merge.next_windows(loaded, AS_OF).collect()}
    assert days == {"a": 14, "x": 2}
    assert states.titles(states.delete(loaded, "x")).count() == 1


def test_collect_shortens_the_window_and_merges(spark):
    schema = "id int, p_event_time string, source string, p_row_id string"
    early = spark.createDataFrame([(i, f"2024-01-{10 + i:02d}T00:00:00Z", "s", "r") for i in range(10)], schema)
    path = new_path(spark, "t-collect")
    query = LogQuery("logs", 30, early, equals={"source": "s"}, drop=("p_row_id",))
    first = collect_all(spark, [query, LogQuery("bad", 30, early, "nope")], path, "2024-01-20 00:00:00").collect()
    assert [(r.title, r.n_logs) for r in first] == [("logs", 10), ("bad", 0)] and first[1].error
    later = early.where("id >= 5").unionByName(spark.createDataFrame([(50, "2024-02-01T00:00:00Z", "s", "r"), (51, "2024-01-30T00:00:00Z", "t", "r")], schema))
    second = collect_all(spark, [LogQuery("logs", 30, later, equals={"source": "s"}, drop=("p_row_id",))], path, "2024-02-12 00:00:00").collect()
    assert [(r.title, r.n_logs) for r in second] == [("logs", 8)]  # ids 3..9 are inside the window, 50 is new
    state = states.get(states.load(spark, f"{path}/state"), "logs").first()
    assert state.record_count == 8 and state.last_data_timestamp == "2024-02-01T00:00:00Z"
    assert state.created_at == "2024-01-20T00:00:00Z" and state.last_run == "2024-02-12T00:00:00Z"

    # the third run appends: one new row, two already there; two more rows leave the window
    newest = spark.createDataFrame(
        [(50, "2024-02-01T00:00:00Z", "s", "r", None), (60, "2024-02-14T00:00:00Z", "s", "r", "x"), (60, "2024-02-14T00:00:00Z", "s", "r", "x")],
        schema + ", extra string",
    )
    query = LogQuery("logs", 30, newest, equals={"source": "s"}, drop=("p_row_id",))
    before = set(spark.read.parquet(f"{path}/data/logs").inputFiles())
    assert not any("2024-01-10" in f for f in before)  # a day before the window of the second run
    third = collect_all(spark, [query], path, "2024-02-14 12:00:00").collect()
    assert [(r.title, r.n_logs, r.error) for r in third] == [("logs", 6, None)]
    rows = read_collected(spark, query, path, "2024-02-14 12:00:00").collect()
    assert sorted((r.id, r.extra) for r in rows) == [(6, None), (7, None), (8, None), (9, None), (50, None), (60, "x")]
    after = set(spark.read.parquet(f"{path}/data/logs").inputFiles())  # no stored file is written again
    assert {f for f in before if "2024-01-1" not in f} < after and len(after - before) == 1

    # a run that finds nothing leaves the state alone
    collect_all(spark, [LogQuery("logs", 30, newest.limit(0))], path, "2024-02-15 00:00:00")
    assert states.get(states.load(spark, f"{path}/state"), "logs").first().last_run == "2024-02-14T12:00:00Z"


def test_an_expired_id_may_return(spark):
    path = new_path(spark, "t-returning")

    def run(day, *rows):
        table = spark.createDataFrame([(str(i), t) for i, t in rows], "id string, p_event_time string")
        report = collect_all(spark, [LogQuery("logs", 5, table)], path, f"2024-01-{day:02d} 00:00:00").first()
        stored = read_collected(spark, LogQuery("logs", 5, table), path, f"2024-01-{day:02d} 00:00:00")
        return report.n_logs, sorted((r.id, r.p_event_time[8:10]) for r in stored.collect())

    first, other = (1, "2024-01-01T12:00:00Z"), (2, "2024-01-02T12:00:00Z")
    assert run(2, first, first) == (1, [("1", "01")])
    assert run(3, first, other) == (2, [("1", "01"), ("2", "02")])
    back = (1, "2024-01-19T12:00:00Z")
    assert run(20, back) == (1, [("1", "19")])
    assert run(21, back, (3, "2024-01-20T12:00:00Z")) == (2, [("1", "19"), ("3", "20")])
    assert {f.split("collected_day=")[1][:10] for f in spark.read.parquet(f"{path}/data/logs").inputFiles()} == {"2024-01-19", "2024-01-20"}


def test_zero_is_an_id_where_nothing_else_is(spark):
    path = new_path(spark, "t-zero")
    for day in (25, 28):
        rows = [(i, f"2024-01-{day - 1}T12:00:00Z") for i in (0, 1, day)]
        zeros = LogQuery("zeros", 5, spark.createDataFrame(rows, "id long, p_event_time string"), key_fields=("id",))
        collect_all(spark, [zeros], path, f"2024-01-{day} 00:00:00")
    stored = read_collected(spark, zeros, path, "2024-01-28 00:00:00")
    assert sorted((r.id, r.p_event_time[8:10]) for r in stored.collect()) == [(0, "24"), (1, "24"), (25, "24"), (28, "27")]
    df = spark.createDataFrame([(0, "a"), (0, "b"), (None, "a")], "id long, timestamp string")
    assert sorted(r[0] for r in df.select(merge.identity(df)).collect()) == ["timestamp=a", "timestamp=a", "timestamp=b"]


def test_pages_never_cut_a_key(spark):
    df = spark.range(100).selectExpr("id", "id div 10 AS k").union(spark.sql("SELECT 100L, null"))
    found = [[r.id for r in p.collect()] for p in logs.pages(df, "k", 25)]
    assert sorted(i for p in found for i in p) == list(range(101)) and len(found) == 4
    halves = list(logs.pages(spark.range(4000), "id", 4000, most_bytes=25_000))  # about 13 bytes a record
    assert sum(p.count() for p in halves) == 4000 and len(halves) > 1


def test_datasets_replace_only_their_log_type(spark, tmp_path):
    path = str(tmp_path / "d")
    logs.write_dataset(spark.createDataFrame([(1, "a"), (2, "b")], "x int, log_type string"), path)
    logs.write_dataset(spark.createDataFrame([(3, "b")], "x int, log_type string"), path, rows_per_file=1)
    assert sorted(tuple(r) for r in spark.read.parquet(path).collect()) == [(1, "a"), (3, "b")]


def test_json_array_files_and_empty_input(spark, tmp_path):
    (tmp_path / "array.json").write_text('[\n  {"a": 1},\n  {"a": 2, "b": {"c": "x"}}\n]')
    assert logs.read_json_logs(spark, str(tmp_path / "array.json"), lines=False).count() == 2
    (tmp_path / "none.json").write_text("[]")
    with pytest.raises(ValueError):
        logs.read_json_logs(spark, str(tmp_path / "none.json"), lines=False)
    with pytest.raises(Exception):
        logs.read_json_logs(spark, str(tmp_path / "absent.json"))


def test_pages_cover_the_table_once(spark):
    df = spark.range(2500).withColumnRenamed("id", "k")
    seen, after = [], None
    while rows := sorted(r.k for r in logs.page(df, "k", 1000, after).collect()):
        seen += rows
        after = rows[-1]
    assert seen == list(range(2500))
    assert [r.k for r in logs.offset_page(df, "k", 3, 10).collect()] == [10, 11, 12]


def test_chunk_size(spark):
    sample = spark.range(100).selectExpr("id", "repeat('x', 1000) AS body")
    assert 70_000 < logs.chunk_size(sample).first().chunk_rows < 80_000
    assert logs.chunk_size(sample.limit(0)).first().chunk_rows == 1000
    assert [logs.halved(n) for n in (4000, 900)] == [2000, 500]


def test_collection_summary(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "log_type string")
    assert {r.title: r.n_logs for r in reports.collection_summary(df).collect()} == {"a": 2, "b": 1, None: 3}


def test_latency_report(spark):
    df = spark.createDataFrame([("m", 1.0, True), ("m", 2.0, True), ("m", 9.0, False), ("n", 5.0, False)], "model string, s double, ok boolean")
    got = {r.model: r for r in reports.latency_report(df, ["model"], "s", "ok").collect()}
    assert (got["m"].total, got["m"].avg_time, got["m"].median_time, got["m"].max_time) == (3, 1.5, 1.5, 2.0)
    assert got["m"].success_rate == pytest.approx(200 / 3)
    assert got["n"].avg_time is None and got["n"].median_time is None


def test_stream_dedupe_forgets_late_rows(spark):
    path = new_path(spark, "t-dedupe")
    spark.sql(
        "SELECT cast(id % 40 AS string) AS id, timestamp_ntz'2024-01-01' + make_dt_interval(cast(id % 40 AS int)) AS timestamp FROM range(200)"
    ).write.parquet(path)
    stream = read_events(spark, path, spark.read.parquet(path).schema, "parquet")
    out = dedupe_stream(stream, merge.identity(stream), "timestamp", 365)
    query = out.writeStream.format("memory").queryName("deduped").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("deduped").count() == 40


def test_work_folder_comes_from_the_session(spark):
    assert new_path(spark, "x").startswith(work_dir(spark))
    staged = stage(spark.range(3), "numbers")
    assert staged.count() == 3 and "parquet" in staged._jdf.queryExecution().executedPlan().toString()


def test_a_pull_is_read_once_and_counted_on_the_way(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)
    rows = [(f"id{i % 70}", f"2024-01-{1 + i % 9:02d}T00:00:00Z", "é" * (i % 3)) for i in range(100)]
    source = spark.createDataFrame(rows, "p_row_id string, p_event_time string, text string")

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    pulled = LogQuery("logs", 30, source.mapInArrow(counted, source.schema), key_fields=("p_row_id",))
    first = collect_all(spark, [pulled], str(tmp_path), "2024-01-10 00:00:00").first()
    assert read.value == 100 and (first.fetched, first.stored, first.n_logs) == (100, 70, 70)
    assert first.bytes == sum(len(f'{{"p_row_id":"{a}","p_event_time":"{b}","text":"{t}"}}'.encode()) for a, b, t in rows)
    assert first.latest_timestamp == "2024-01-09T00:00:00Z" and first.rate.endswith("events/min")
    again = collect_all(spark, [pulled], str(tmp_path), "2024-01-10 00:00:00").first()
    assert read.value == 200 and again.fetched == sum(t >= "2024-01-08" for _, t, _ in rows) and (again.stored, again.n_logs) == (0, 70)
    nothing = collect_all(spark, [LogQuery("logs", 30, source.limit(0), key_fields=("p_row_id",))], str(tmp_path), "2024-01-11 00:00:00").first()
    assert (nothing.fetched, nothing.stored, nothing.bytes, nothing.n_logs, nothing.error) == (0, 0, 0, 70, None)
