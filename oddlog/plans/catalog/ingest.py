"""Sources, sinks, filters, merging and ingest state."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ...functions import timefeat
from ...functions.names import c
from ...operators import merge, reports
from ...operators.flatten import drop_internal, exclude, flatten, normalise_names, project_fill, time_source
from ...session import new_path
from ...sources import logs, paging, state as states
from ..collect import LogQuery, collect_all, read_collected
from ..train import enough_rows
from .registry import query, table
from .views import K_SQL, events, fixed_sql, r6

AS_OF = "2024-02-01 00:00:00"


@query(f"""SELECT event_id, user_id AS "actor.id", event_type AS "actor.kind", {K_SQL} AS "props.k", value FROM events""")
def scan_json_logs(spark: SparkSession, folder: str) -> DataFrame:
    """Nested events written as JSON lines, read back with an inferred schema, flattened."""
    nested = events(spark, folder).select(
        "event_id", F.struct(F.col("user_id").alias("id"), F.col("event_type").alias("kind")).alias("actor"), "props", "value"
    )
    path = new_path(spark, "json-logs")
    nested.write.json(path)
    return flatten(logs.read_json_logs(spark, path))


@query("SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY l_returnflag")
def scan_table(spark: SparkSession, folder: str) -> DataFrame:
    lines = logs.read_table(spark, f"{folder}/lineitem.parquet")
    return lines.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity")
    )


@query("SELECT * EXCLUDE (props, user_id) FROM events")
def select_exclude(spark, folder):
    return exclude(table(spark, folder, "events"), "props", "user_id", "not_there")


@query("SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-02-01' - INTERVAL 14 DAY")
def trailing_window(spark, folder):
    return merge.occurs_since(table(spark, folder, "events"), AS_OF, 14, "ts").select("event_id", "ts")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def source_filter(spark, folder):
    return table(spark, folder, "orders").where(c("o_orderstatus") == "F").select("o_orderkey", "o_totalprice")


@query(
    "SELECT event_type, count(*) AS n FROM events"
    " WHERE ts >= TIMESTAMP '2024-02-01' - INTERVAL 20 DAY AND value > 10.0 GROUP BY event_type"
)
def param_query(spark, folder):
    return logs.param_query(
        spark,
        "SELECT event_type, count(*) AS n FROM {events} WHERE ts >= cast(:as_of AS timestamp_ntz)"
        " - make_dt_interval(:days) AND value > :low GROUP BY event_type",
        {"as_of": AS_OF, "days": 20, "low": 10.0},
        events=table(spark, folder, "events"),
    )


@query("SELECT o_orderdate AS p_event_time, o_totalprice AS total, o_orderpriority AS priority FROM orders")
def internal_column_filter(spark, folder):
    named = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("p_row_id"),
        F.col("o_orderstatus").alias("p_log_type"),
        F.col("o_orderdate").alias("p_event_time"),
        F.col("o_totalprice").alias("total"),
        F.col("o_orderpriority").alias("priority"),
    )
    return drop_internal(named)


@query("SELECT event_id, value, CAST(0 AS INTEGER) AS packets, user_id FROM events")
def project_fill_absent(spark, folder):
    return project_fill(table(spark, folder, "events"), ["event_id", "value", "packets", "user_id"])


@query(
    'SELECT c_custkey AS "eventId", coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END, c_name) AS "eventName",'
    ' c_mktsegment AS "awsRegion",'
    ' c_nationkey AS "userIdentity.type", c_acctbal AS balance FROM customer'
)
def normalize_fields(spark, folder):
    lower = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("eventid"),
        F.col("c_name").alias("eventname"),
        F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("eventName"),
        F.col("c_mktsegment").alias("awsregion"),
        F.col("c_nationkey").alias("useridentity.type"),
        F.col("c_acctbal").alias("balance"),
    )
    return normalise_names(lower)


def _timed(spark, folder) -> DataFrame:
    """Events with three sparse time fields, some unreadable."""
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    kind = F.col("event_type")
    return table(spark, folder, "events").select(
        "event_id",
        "event_type",
        F.when(kind == "click", F.concat(text, F.lit("Z"))).when(kind == "error", F.lit("")).alias("timestamp"),
        F.when(kind == "view", F.concat(text, F.lit("+02:00"))).alias("createdAt"),
        F.when(kind == "signup", F.concat(F.lit("at "), text))
        .when(kind != "purchase", F.concat(text, F.lit("Z")))
        .alias("p_event_time"),
    )


@query(
    "SELECT event_id, event_type FROM (SELECT event_id, event_type, date_trunc('second', ts) AS t FROM events)"
    " WHERE CASE event_type WHEN 'view' THEN t - INTERVAL 2 HOUR WHEN 'click' THEN t WHEN 'error' THEN t END"
    " >= TIMESTAMP '2024-02-01' - INTERVAL 10 DAY OR event_type IN ('signup', 'purchase')"
)
def retention_filter(spark, folder):
    return merge.retain(_timed(spark, folder), AS_OF, 10).select("event_id", "event_type")


@query(
    "SELECT event_id, CASE event_type WHEN 'signup' THEN 'at ' || t WHEN 'purchase' THEN NULL ELSE t || 'Z' END AS first_time"
    " FROM (SELECT *, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS t FROM events)"
)
def first_present_time(spark, folder):
    timed = _timed(spark, folder)
    return timed.select("event_id", time_source(timed).alias("first_time"))


@query(
    "SELECT event_id, CASE event_type WHEN 'click' THEN t || 'Z' WHEN 'view' THEN t || '+02:00' WHEN 'error' THEN t || 'Z'"
    " WHEN 'signup' THEN 'at ' || t END AS first_time"
    " FROM (SELECT *, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS t FROM events)"
)
def first_truthy_time(spark, folder):
    timed = _timed(spark, folder)
    return timed.select("event_id", merge.first_truthy(timed, merge.TIME_FIELDS_INGEST).alias("first_time"))


@query(
    "SELECT user_id, event_id FROM events WHERE user_id IN"
    " (SELECT user_id FROM events GROUP BY user_id HAVING count(*) >= 65)"
)
def min_rows_gate(spark, folder):
    return enough_rows(table(spark, folder, "events"), ["user_id"], 65).select("user_id", "event_id")


# ---- merging --------------------------------------------------------------------------------------------------------


def _batches(spark, folder) -> tuple[DataFrame, DataFrame]:
    """Stored events and a later pull with changed values, of which about half carry ids already stored."""
    stored = table(spark, folder, "events").select(
        F.col("event_id").alias("id"), F.col("ts").alias("timestamp"), "event_type", "value"
    )
    pulled = stored.select(
        (F.col("id") * 2).alias("id"),
        F.col("timestamp"),
        "event_type",
        (F.col("value") + 1).alias("value"),
        F.lit("pull-2").alias("batch"),
    )
    return stored, pulled


BATCHES_SQL = """pulls AS (
  SELECT 0 AS src, event_id AS id, ts, event_type, value, CAST(NULL AS VARCHAR) AS batch FROM events
  UNION ALL SELECT 1, event_id * 2, ts, event_type, value + 1, 'pull-2' FROM events),
keyed AS (SELECT *, CASE WHEN id <> 0 THEN 'id=' || id ELSE 'timestamp=' || ts END AS k FROM pulls),
merged AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY src) AS rn FROM keyed) WHERE rn = 1)"""


@query(f"WITH {BATCHES_SQL} SELECT CAST(src AS INTEGER) AS src_rank, id, ts AS timestamp, event_type, round(value, 6) AS value, batch FROM pulls")
def union_logs(spark, folder):
    return merge.union_logs(*_batches(spark, folder)).withColumn("value", r6("value"))


@query(f"WITH {BATCHES_SQL} SELECT CAST(src AS INTEGER) AS src_rank, id, ts AS timestamp, event_type, round(value, 6) AS value, batch FROM merged")
def dedupe_keep_first(spark, folder):
    both = merge.union_logs(*_batches(spark, folder))
    return merge.keep_first(both, merge.identity(both), ["src_rank"]).withColumn("value", r6("value"))


@query(
    f"WITH {BATCHES_SQL} SELECT id, ts AS timestamp, event_type, round(value, 6) AS value, batch FROM merged"
    " WHERE ts >= TIMESTAMP '2024-02-01' - INTERVAL 21 DAY"
)
def incremental_merge(spark, folder):
    stored, pulled = _batches(spark, folder)
    return merge.merge_incremental(stored, pulled, AS_OF, 21).withColumn("value", r6("value"))


@query(
    f"WITH {BATCHES_SQL} SELECT id, ts AS timestamp, event_type, round(value, 6) AS value, batch FROM merged"
    " WHERE ts >= TIMESTAMP '2024-02-01' - INTERVAL 21 DAY"
)
def incremental_append(spark, folder):
    """The same merge when the stored rows are known to be unique: they are not shuffled."""
    stored, pulled = _batches(spark, folder)
    merged = merge.merge_incremental(stored, pulled, AS_OF, 21, existing_unique=True)
    return merged.withColumn("value", r6("value"))


@query(
    "SELECT id, value FROM (SELECT event_id * 2 AS id, round(value + 1, 6) AS value FROM events)"
    " WHERE id <> 0 AND id NOT IN (SELECT event_id FROM events)"
)
def seen_id_anti(spark, folder):
    stored, pulled = _batches(spark, folder)
    return merge.unseen(stored, pulled).select("id", r6("value").alias("value"))


@query(
    "SELECT lang, source, count(*) AS n_docs, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM"
    " (SELECT DISTINCT text, lang, source, n_chars FROM documents) GROUP BY ALL"
)
def dedupe_whole_record(spark, folder):
    """Records without any id are compared as a whole, however long; exact copies collapse."""
    docs = table(spark, folder, "documents").drop("doc_id")
    unique = merge.keep_first(docs, merge.identity(docs), ["lang"])
    return unique.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_chars").alias("n_chars"))


# ---- time windows, state --------------------------------------------------------------------------------------------


@query(
    "SELECT event_type, strftime(max(date_trunc('second', ts)), '%Y-%m-%dT%H:%M:%S') || 'Z' AS latest_timestamp"
    " FROM events GROUP BY event_type"
)
def latest_timestamp(spark, folder):
    timed = table(spark, folder, "events").select(
        "event_type", F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")).alias("createdAt")
    )
    return merge.latest_timestamp(timed, ["event_type"], AS_OF)


def _user_state(spark, folder) -> DataFrame:
    """One state row per user as title; users seen once never completed a run."""
    seen = table(spark, folder, "events").groupBy("user_id").agg(F.max("ts").alias("last"), F.count("ts").alias("n"))
    return seen.select(
        F.concat(F.lit("user "), F.col("user_id")).alias("title"),
        F.lit(14).alias("window_days"),
        F.lit("2024-01-31T00:00:00Z").alias("last_run"),
        F.when(F.col("n") % 5 != 0, F.concat(F.date_format("last", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))).alias(
            "last_data_timestamp"
        ),
        F.col("n").alias("record_count"),
        F.lit("2024-01-01T00:00:00Z").alias("created_at"),
        F.lit("2024-01-31T00:00:00Z").alias("updated_at"),
    )


@query(
    "SELECT 'user ' || user_id AS title, CASE WHEN count(*) % 5 = 0 THEN 14 ELSE"
    " CAST(least(greatest(1, floor(date_diff('second', date_trunc('second', max(ts)), TIMESTAMP '2024-02-05') / 86400) + 1),"
    " 14) AS INTEGER) END AS next_days FROM events GROUP BY user_id"
)
def incremental_window(spark, folder):
    return merge.next_windows(_user_state(spark, folder), "2024-02-05 00:00:00").select("title", "next_days")


RECENT_SQL = """recent AS (SELECT user_id % 3 AS g, ts, event_id, row_number() OVER
    (PARTITION BY user_id % 3 ORDER BY event_id DESC) AS rn, count(*) OVER (PARTITION BY user_id % 3) AS n FROM events),
dens AS (SELECT g, max(n) AS n, count(*) AS timed, min(ts) AS a, max(ts) AS b FROM recent WHERE rn <= 1000 GROUP BY g),
est AS (SELECT *, greatest(n, CAST(floor(timed / greatest(0.1, date_diff('microsecond', a, b) / 86400000000.0) * 30) AS BIGINT))
  AS total FROM dens)"""


@query(
    f"WITH {RECENT_SQL} SELECT g AS title, n AS current_count, total AS estimated_total,"
    " round(least(100.0, n / total * 100), 6) AS progress_pct,"
    " strftime(a, '%m/%d %H:%M') || ' to ' || strftime(b, '%m/%d %H:%M') AS time_range FROM est"
    " UNION ALL SELECT 3, 0, 0, 0.0, 'No data'"
)
def event_density(spark, folder):
    titled = table(spark, folder, "events").select(
        (F.col("user_id") % 3).alias("title"), "event_id", F.col("ts").alias("timestamp")
    )
    titles = titled.select("title").distinct().union(spark.range(3, 4))  # one title has no rows
    out = merge.density(titled, ["title"], 30, [F.col("event_id")], groups=titles)
    return out.withColumn("progress_pct", r6("progress_pct"))


@query(
    "SELECT user_id, strftime(min(ts), '%m/%d %H:%M') || ' to ' || strftime(max(ts), '%m/%d %H:%M') AS time_range"
    " FROM events GROUP BY user_id"
)
def time_range_label(spark, folder):
    spans = table(spark, folder, "events").groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return spans.select("user_id", timefeat.range_label(F.col("a"), F.col("b")).alias("time_range"))


@query(
    "SELECT 'user ' || user_id AS title, count(*) % 5 = 0 AS renewed,"
    " CASE WHEN count(*) % 5 = 0 THEN count(*) * 2 ELSE count(*) END AS record_count,"
    " '2024-01-01T00:00:00Z' AS created_at,"
    " CASE WHEN count(*) % 5 = 0 THEN '2024-02-05T00:00:00Z' ELSE '2024-01-31T00:00:00Z' END AS updated_at"
    " FROM events WHERE user_id <> 7 GROUP BY user_id"
)
def state_upsert(spark, folder):
    """Titles without data so far get a run; one title is deleted."""
    state = _user_state(spark, folder)
    runs = state.where("last_data_timestamp IS NULL").select(
        "title", F.lit("2024-02-04T00:00:00Z").alias("latest_timestamp"), (F.col("record_count") * 2).alias("n_logs")
    )
    renewed = states.after_run(state, runs, "2024-02-05T00:00:00")
    after = states.delete(states.upsert(state, renewed), "user 7")
    return after.select(
        "title",
        (F.col("last_run") == "2024-02-05T00:00:00Z").alias("renewed"),
        "record_count",
        "created_at",
        "updated_at",
    )


@query("SELECT event_id, event_type AS log_type, value FROM events")
def dataset_sink_roundtrip(spark, folder):
    """Datasets per log type: written, one of them replaced, all read back."""
    path = new_path(spark, "datasets")
    typed = table(spark, folder, "events").select("event_id", F.col("event_type").alias("log_type"), "value")
    logs.write_dataset(typed.withColumn("value", F.col("value") + 1), path, rows_per_file=5000)
    logs.write_dataset(typed, path, rows_per_file=5000)
    return spark.read.schema(typed.schema).parquet(path)


@query(
    "WITH s AS (SELECT event_id, user_id, event_type FROM events ORDER BY event_id LIMIT 1000)"
    " SELECT count(*) AS sampled, CAST(greatest(floor(80000000.0 / avg(strlen('{\"event_id\":' || event_id ||"
    " ',\"user_id\":' || user_id || ',\"event_type\":\"' || event_type || '\"}'))), 1000) AS BIGINT) AS chunk_rows FROM s"
)
def chunk_size(spark, folder):
    sample = logs.page(table(spark, folder, "events").select("event_id", "user_id", "event_type"), "event_id", logs.SAMPLE_ROWS)
    return logs.chunk_size(sample)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 500 OFFSET 1000")
def paged_read(spark, folder):
    return logs.offset_page(table(spark, folder, "orders"), "o_orderkey", 500, 1000).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 600 ORDER BY o_orderkey LIMIT 500")
def paged_read_by_key(spark, folder):
    return logs.page(table(spark, folder, "orders"), "o_orderkey", 500, after=600).select("o_orderkey", "o_totalprice")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def paged_read_all(spark, folder):
    """The whole table cut into pages on a key that repeats, written page by page and read back."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    path = new_path(spark, "pages")
    size = logs.chunk_size(lines).first().chunk_rows // 25
    paging.write_pages(lines, paging.plan_pages(lines, "l_orderkey", size), path)
    return spark.read.parquet(path).select("l_orderkey", "l_linenumber", "l_quantity")


PAGE_ROWS, PAGE_BYTES = 1000, 40_000
_PAGE_SQL = (
    "WITH s AS (SELECT l_partkey, l_orderkey, l_linenumber, strlen('{\"l_partkey\":' || l_partkey || ',\"l_orderkey\":'"
    " || l_orderkey || ',\"l_linenumber\":' || l_linenumber || '}') AS size FROM lineitem),"
    " k AS (SELECT l_partkey AS key, count(*) AS n, sum(size) AS b FROM s GROUP BY 1),"
    f" w AS (SELECT *, greatest(n * {PAGE_BYTES}::HUGEINT, b * {PAGE_ROWS}::HUGEINT) AS w FROM k),"
    f" p AS (SELECT key, n, b, ((sum(w) OVER (ORDER BY key) - w)::HUGEINT // {PAGE_ROWS * PAGE_BYTES})::BIGINT AS page FROM w)"
)


def _part_lines(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber")
    return lines, paging.plan_pages(lines, "l_partkey", PAGE_ROWS, PAGE_BYTES)


@query(
    _PAGE_SQL + " SELECT page, min(key) AS first_key, max(key) AS last_key, count(*) AS keys,"
    " CAST(sum(n) AS BIGINT) AS n_logs, CAST(sum(b) AS BIGINT) AS bytes FROM p GROUP BY page"
)
def page_plan(spark, folder):
    """Pages of a thousand rows or 40 kB, cut from one histogram of the keys."""
    return _part_lines(spark, folder)[1].plan


@query(_PAGE_SQL + " SELECT page, l_partkey, l_orderkey, l_linenumber FROM s JOIN p ON l_partkey = key")
def page_numbers(spark, folder):
    """Every row with its page."""
    lines, cut = _part_lines(spark, folder)
    return cut.number(lines)


@query("SELECT event_type AS title, count(*) AS n_logs FROM events GROUP BY ROLLUP (event_type)")
def collection_rollup(spark, folder):
    return reports.collection_summary(table(spark, folder, "events"), "event_type")


@query(
    "SELECT 'clicks' AS title, count(*) AS n_logs, true AS ok FROM events WHERE event_type = 'click'"
    " AND ts >= TIMESTAMP '2024-02-01' - INTERVAL 30 DAY"
    " UNION ALL SELECT 'everything', count(*), true FROM events WHERE ts >= TIMESTAMP '2024-02-01' - INTERVAL 14 DAY"
    " UNION ALL SELECT 'broken', 0, false"
)
def collect_all_queries(spark, folder):
    """Three runs of three configured queries: stored, merged, appended to; one query always fails."""
    ev = table(spark, folder, "events")
    queries = [
        LogQuery("clicks", 30, ev, "ts", {"event_type": "click"}, ("props",), ("event_id",)),
        LogQuery("everything", 14, ev, "ts", {}, (), ("event_id",)),
        LogQuery("broken", 30, ev, "no_such_field"),
    ]
    path = new_path(spark, "collected")
    collect_all(spark, queries, path, "2024-01-25 00:00:00")
    collect_all(spark, queries, path, "2024-01-29 00:00:00")
    report = collect_all(spark, queries, path, AS_OF)
    return report.select("title", "n_logs", F.col("error").isNull().alias("ok"))


METERED = ("2024-01-20", "2024-01-25")
_METERED_SQL = (
    "SELECT {run} AS run, 'clicks' AS title, count(*) AS fetched, count(*) FILTER (ts >= TIMESTAMP '{known}') AS stored,"
    " CAST(sum(strlen('{{\"event_id\":' || event_id || ',\"ts\":\"2024-01-01T00:00:00.000\",\"user_id\":' || user_id ||"
    " ',\"event_type\":\"click\",\"value\":' || value || '}}')) AS BIGINT) AS bytes, max(ts) AS latest, true AS rated FROM {rows}"
)


@query(
    f"WITH clicks AS (SELECT * FROM events WHERE event_type = 'click' AND ts < TIMESTAMP '{METERED[1]}'),"
    f" a AS (SELECT * FROM clicks WHERE ts < TIMESTAMP '{METERED[0]}' AND ts >= TIMESTAMP '{METERED[0]}' - INTERVAL 30 DAY),"
    f" w AS (SELECT greatest(1, least(30, floor(epoch(TIMESTAMP '{METERED[1]}' - max(ts)) / 86400)::INT + 1)) AS days FROM a),"
    f" b AS (SELECT clicks.* FROM clicks, w WHERE ts >= TIMESTAMP '{METERED[1]}' - to_days(days)) "
    + " UNION ALL ".join(_METERED_SQL.format(run=i + 1, known=known, rows=rows) for i, (known, rows) in enumerate([("1900-01-01", "a"), (METERED[0], "b")]))
)
def collect_metrics(spark, folder):
    """Two runs of one query: what each fetched, what was new, its bytes and its latest time, observed while writing."""
    path, reports_ = new_path(spark, "metered"), []
    for run, day in enumerate(METERED, 1):
        ev = table(spark, folder, "events").where(F.col("ts") < F.lit(day).cast("timestamp_ntz"))
        clicks = LogQuery("clicks", 30, ev, "ts", {"event_type": "click"}, ("props",), ("event_id",))
        found = collect_all(spark, [clicks], path, f"{day} 00:00:00")
        latest = F.col("latest_timestamp").cast("timestamp_ntz").alias("latest")
        rated = F.col("rate").endswith("events/min").alias("rated")
        reports_.append(found.select(F.lit(run).alias("run"), "title", "fetched", "stored", "bytes", latest, rated))
    return reduce(DataFrame.union, reports_)


RETURNING = ("2024-01-10", "2024-01-12", "2024-01-25", "2024-01-28")


def _pull_sql(day: str) -> str:
    return (
        f"SELECT event_id % 4000 AS id, min(ts) AS ts FROM events WHERE ts >= TIMESTAMP '{day}' - INTERVAL 1 DAY AND ts <"
        f" TIMESTAMP '{day}' GROUP BY ALL"
    )


@query(
    f"WITH a AS ({_pull_sql(RETURNING[2])}), b AS ({_pull_sql(RETURNING[3])})"
    " SELECT id, ts FROM a UNION ALL SELECT id, ts FROM b WHERE id NOT IN (SELECT id FROM a)"
)
def collect_returning_id(spark, folder):
    """Four runs with a window of five days: ids of the first two have expired when they return in the third."""
    path = new_path(spark, "returning")
    for day in RETURNING:
        end = F.lit(day).cast("timestamp_ntz")
        ev = table(spark, folder, "events").where((F.col("ts") >= end - F.expr("INTERVAL 1 DAY")) & (F.col("ts") < end))
        pull = ev.groupBy((F.col("event_id") % 4000).alias("id")).agg(F.min("ts").alias("ts"))
        last = LogQuery("returning", 5, pull, "ts", key_fields=("id",))
        collect_all(spark, [last], path, f"{day} 00:00:00")
    return read_collected(spark, last, path, f"{RETURNING[-1]} 00:00:00")


# ---- labels ---------------------------------------------------------------------------------------------------------


def _label_sql(n: str) -> str:
    return (
        f"CASE WHEN {n} >= 1000000 THEN {fixed_sql(f'{n} / 1000000', 1)} || 'M' WHEN {n} >= 1000 THEN"
        f" {fixed_sql(f'{n} / 1000', 1)} || 'k' ELSE CAST(CAST({n} AS BIGINT) AS VARCHAR) END"
    )


def _labels_sql() -> str:
    rate, left = "o_custkey / secs * 60", "secs * (100 - pct) / pct"
    return f"""WITH runs AS (SELECT o_orderkey, o_custkey, o_totalprice, o_totalprice / 100 AS secs,
    CAST(o_orderkey % 101 AS DOUBLE) AS pct FROM orders)
SELECT o_orderkey,
  CASE WHEN o_custkey >= 1000000 THEN {fixed_sql('o_custkey / 1000000', 1)} || 'M'
       ELSE {fixed_sql('o_custkey / 1000', 1)} || 'k' END AS current_label,
  {_label_sql('floor(o_totalprice * 10)')} AS estimated_label,
  CASE WHEN {rate} >= 1000000 THEN {fixed_sql(f'{rate} / 1000000', 1)} || 'M events/min'
       WHEN {rate} >= 1000 THEN {fixed_sql(f'{rate} / 1000', 1)} || 'k events/min'
       ELSE {fixed_sql(rate, 0)} || ' events/min' END AS rate,
  CASE WHEN pct <= 0 OR pct >= 100 THEN 'unknown' WHEN {left} > 3600 THEN {fixed_sql(f'{left} / 3600', 1)} || ' hours'
       WHEN {left} > 60 THEN {fixed_sql(f'{left} / 60', 0)} || ' minutes'
       ELSE {fixed_sql(left, 0)} || ' seconds' END AS eta
FROM runs"""


@query(_labels_sql())
def count_labels(spark, folder):
    """Progress texts, one run per order."""
    runs = table(spark, folder, "orders")
    labelled = reports.run_labels(
        runs.withColumns({"secs": F.col("o_totalprice") / 100, "pct": (F.col("o_orderkey") % 101).cast("double")}),
        F.col("o_custkey"),
        F.col("secs"),
        F.col("pct"),
        F.floor(F.col("o_totalprice") * 10),
    )
    return labelled.select("o_orderkey", "current_label", "estimated_label", "rate", "eta")


@query(
    "SELECT o_orderpriority AS model, count(*) AS total,"
    " round(avg(CASE WHEN o_orderstatus <> 'F' THEN 1.0 ELSE 0 END) * 100, 6) AS success_rate,"
    " round(avg(t), 6) AS avg_time, min(t) AS min_time, max(t) AS max_time, round(stddev_samp(t), 6) AS std_time,"
    " round(quantile_cont(t, 0.5), 6) AS median_time"
    " FROM (SELECT *, CASE WHEN o_orderstatus <> 'F' THEN o_totalprice / 1000 END AS t FROM orders) GROUP BY o_orderpriority"
)
def latency_report(spark, folder):
    results = table(spark, folder, "orders").select(
        F.col("o_orderpriority").alias("model"),
        (F.col("o_totalprice") / 1000).alias("seconds"),
        (F.col("o_orderstatus") != "F").alias("ok"),
    )
    report = reports.latency_report(results, ["model"], "seconds", "ok")
    for name in ("success_rate", "avg_time", "std_time", "median_time"):
        report = report.withColumn(name, r6(name))
    return report
