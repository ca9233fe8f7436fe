"""Scoring and de-duplication on Structured Streaming, run until all input is consumed and compared with batch SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ...operators import merge
from ...session import new_path
from ...streaming import forward, ingest, score as streams
from .detection import EVENTS_SQL, LIMIT, fixed_scorer, security_events
from .ingest import _batches
from .registry import query, table
from .views import r6


def _as_json(df: DataFrame, label: str) -> str:
    path = new_path(df.sparkSession, label)
    df.write.json(path)
    return path


def _run(spark: SparkSession, rows: DataFrame, label: str, only_alerts: bool = False) -> DataFrame:
    out = new_path(spark, label)
    running = streams.write_results(rows, out, new_path(spark, f"{label}-checkpoint"), only_alerts)
    running.awaitTermination()
    return spark.read.schema(rows.schema).parquet(out)


def _scored_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Events arriving as JSON lines, scored with the same transform as a batch."""
    raw = security_events(spark, folder)
    arriving = streams.read_events(spark, _as_json(raw, "arriving"), raw.schema)
    return streams.detect_stream(arriving, fixed_scorer(spark, folder), LIMIT, keep=("event_id",))


@query(
    f"WITH {EVENTS_SQL} SELECT event_id, log_type, is_anomaly, round(decision, 6) AS anomaly_score, explanation, error FROM res"
)
def stream_detect(spark, folder):
    rows = _run(spark, _scored_stream(spark, folder), "stream-results")
    return rows.select(
        "event_id", "log_type", "is_anomaly", r6("anomaly_score").alias("anomaly_score"), "explanation", "error"
    )


@query(f"WITH {EVENTS_SQL} SELECT event_id, log_type, explanation FROM res WHERE is_anomaly")
def stream_alerts(spark, folder):
    return _run(spark, _scored_stream(spark, folder), "stream-alerts", True).select("event_id", "log_type", "explanation")


@query("SELECT b AS batch_id, count(*) AS rows, true AS timed FROM events, range(4) t(b) WHERE event_id % 4 = b GROUP BY b")
def stream_metrics(spark, folder):
    """Scoring in four micro-batches, a quarter of the events each, and what the engine says of each batch."""
    raw, path = security_events(spark, folder), new_path(spark, "quarters")
    for part in range(4):  # files are taken in the order of their writing
        raw.where(F.col("event_id") % 4 == part).coalesce(1).write.mode("append").json(path)
    arriving = streams.read_events(spark, path, raw.schema, maxFilesPerTrigger=1)
    rows = streams.detect_stream(arriving, fixed_scorer(spark, folder), LIMIT, keep=("event_id",))
    running = streams.write_results(rows, new_path(spark, "quarter-results"), new_path(spark, "quarter-checkpoint"))
    running.awaitTermination()
    found = streams.run_metrics(spark, running)
    timed = (F.col("duration_ms") > 0) & (F.col("rows_per_second") > 0)
    return found.select("batch_id", "rows", timed.alias("timed"))


@query("SELECT event_id AS id FROM events UNION SELECT event_id * 2 FROM events")
def stream_dedupe(spark, folder):
    """Stored and newly pulled events arriving together; each id is passed on once."""
    stored, pulled = _batches(spark, folder)
    path = new_path(spark, "pulled")
    both = merge.union_logs(stored, pulled)
    both.write.parquet(path)
    arriving = streams.read_events(spark, path, both.schema, "parquet")
    return _run(spark, streams.dedupe_stream(arriving, merge.identity(arriving), "timestamp", 60), "deduped").select("id")


WINDOW, LATE, RUN_DAYS = 5, 2, 8
DAY_SQL = "datediff('day', DATE '2024-01-01', CAST(ts AS DATE))"
# Greedy by day: the first day of each (user, type), then the first that lies a window later, and so on.
FIRST_SQL = (
    f"days AS (SELECT user_id, event_type, {DAY_SQL} AS d, min(ts) AS ts FROM events GROUP BY ALL),"
    " picked AS (SELECT user_id, event_type, min(d) AS d FROM days GROUP BY ALL"
    " UNION ALL SELECT p.user_id, p.event_type, min(n.d) FROM picked p JOIN days n ON n.user_id = p.user_id"
    f" AND n.event_type = p.event_type AND n.d >= p.d + {WINDOW} GROUP BY ALL)"
)


def _ingested(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Events pulled by days over several runs from one checkpoint, at last the first days again, which is too late."""
    events = table(spark, folder, "events").select("event_id", "ts", "user_id", "event_type")
    day = F.datediff("ts", F.lit("2024-01-01"))
    source, out, checkpoint = (new_path(spark, f"keyed-{part}") for part in ("in", "out", "checkpoint"))
    counts = None
    last = events.agg(F.max(day)).first()[0] or 0
    pulls = [events.where(F.floor(day / RUN_DAYS) == run) for run in range(last // RUN_DAYS + 1)]
    for run, pull in enumerate([*pulls, events.where(day < 3)]):
        pull.write.mode("append").parquet(source)
        arriving = streams.read_events(spark, source, events.schema, "parquet")
        key = F.concat_ws("/", "user_id", "event_type")
        running = ingest.start_ingest(arriving, out, checkpoint, WINDOW, LATE, key, F.col("ts"))
        running.awaitTermination()
        found = ingest.ingest_counts(spark, running).drop("batch_id").select(F.lit(run).alias("run"), "*")
        counts = found if counts is None else counts.unionByName(found)
    return spark.read.schema(events.schema).parquet(out), counts


@query(f"WITH RECURSIVE {FIRST_SQL} SELECT user_id, event_type, ts FROM picked JOIN days USING (user_id, event_type, d)")
def stream_first_of_key(spark, folder):
    """The first event of each user and type passes, and again the first one five days or more after that."""
    return _ingested(spark, folder)[0].select("user_id", "event_type", "ts")


@query(
    f"WITH RECURSIVE {FIRST_SQL}, pulls AS (SELECT {DAY_SQL} // {RUN_DAYS} AS run, count(*) AS read FROM events GROUP BY ALL),"
    f" kept AS (SELECT d // {RUN_DAYS} AS run, count(*) AS passed FROM picked GROUP BY ALL)"
    " SELECT CAST(run AS INTEGER) AS run, read, 0::BIGINT AS late, read - coalesce(passed, 0) AS duplicates, coalesce(passed, 0) AS passed"
    " FROM pulls LEFT JOIN kept USING (run)"
    f" UNION ALL SELECT CAST((SELECT max(run) + 1 FROM pulls) AS INTEGER), count(*), count(*), 0, 0 FROM events WHERE {DAY_SQL} < 3"
)
def stream_ingest_counts(spark, folder):
    """Events read, late, repeated and passed on by each run."""
    return _ingested(spark, folder)[1]


@query(f"WITH {EVENTS_SQL} SELECT event_id, log_type, explanation FROM res WHERE is_anomaly")
def stream_alerts_once(spark, folder):
    """Alerts handed on by a stream whose checkpoint is then lost, so that every micro-batch comes a second time."""
    rows, out = _scored_stream(spark, folder), new_path(spark, "forwarded")
    for attempt in (1, 2):
        checkpoint = new_path(spark, f"forward-checkpoint-{attempt}")
        forward.forward_alerts(rows, out, checkpoint, "alerts").awaitTermination()
    return forward.forwarded(spark, out, rows.schema).select("event_id", "log_type", "explanation")
