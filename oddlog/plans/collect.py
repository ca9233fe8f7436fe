"""The collect job: window, filter, merge, state and storage for every configured query."""

from __future__ import annotations

import time
from contextlib import contextmanager
from dataclasses import dataclass, field
from datetime import datetime
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from ..functions import timefeat
from ..functions.names import IDENTITY_FIELDS, c
from ..functions.text import rate_label
from ..operators import merge
from ..operators.flatten import exclude, record_size
from ..sources import state as states

DAY = "collected_day"  # partition column of stored datasets
ROW_ID, ROW_AT = "collected_key", "collected_at"  # key and time of a stored row
ROW_TIME = "collected_time"


@dataclass
class LogQuery:
    """One configured query over a lake table."""

    title: str
    window_days: int
    table: DataFrame
    time_field: str = "p_event_time"
    equals: dict = field(default_factory=dict)
    drop: tuple[str, ...] = ()
    key_fields: tuple[str, ...] = IDENTITY_FIELDS


def extract(query: LogQuery, as_of: datetime | str, days: int) -> DataFrame:
    """The query's rows of the last ``days`` days; filters and the projection reach the scan."""
    rows = merge.occurs_since(query.table, as_of, days, query.time_field)
    for name, value in query.equals.items():
        rows = rows.where(c(name) == F.lit(value))
    return exclude(rows, *query.drop)


def time_fields(query: LogQuery, df: DataFrame) -> tuple[str, ...]:
    return tuple(f for f in dict.fromkeys((*merge.TIME_FIELDS_INGEST, query.time_field)) if f in df.columns)


def first_day(as_of: datetime | str, window_days: int):
    return (timefeat.moment(as_of) - F.make_dt_interval(F.lit(window_days))).cast("date")


def read_collected(spark: SparkSession, query: LogQuery, path: str, as_of: datetime | str) -> DataFrame:
    """The dataset of a query as of a moment: rows inside its window. Folders of earlier days are not opened."""
    stored = spark.read.option("mergeSchema", "true").parquet(f"{path}/data/{query.title}")
    recent = stored.where(F.col(DAY).isNull() | (F.col(DAY) >= first_day(as_of, query.window_days))).drop(DAY, ROW_ID, ROW_AT)
    return merge.retain(recent, as_of, query.window_days, time_fields(query, recent))


def write_days(df: DataFrame, query: LogQuery, path: str) -> None:
    """Add rows to a dataset, in one folder per event day.

    Rebalancing gives files of even size: many small days share a task, a large day is split over several.
    """
    rows = df.withColumn(DAY, F.col(ROW_TIME).cast("date")).drop(ROW_TIME).hint("rebalance", DAY)
    rows.write.mode("append").partitionBy(DAY).parquet(f"{path}/data/{query.title}")


def drop_expired(spark: SparkSession, query: LogQuery, path: str, as_of: datetime | str) -> list[str]:
    """Delete the folders of days that lie wholly before the window; their names."""
    day = spark.range(1).select(first_day(as_of, query.window_days).cast("string")).first()[0]
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{path}/data/{query.title}")
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = []
    for entry in files.listStatus(folder) if files.exists(folder) else []:
        name, _, value = entry.getPath().getName().partition("=")
        if name == DAY and value[:1].isdigit() and value < day:
            files.delete(entry.getPath(), True)
            gone.append(value)
    return gone


@contextmanager
def observed_whole(spark: SparkSession):
    """Within it, a write that turns out to be empty is still carried out as planned.

    Otherwise adaptive execution puts an empty relation in its place, and with it what was observed on the way is lost.
    """
    key = "spark.sql.adaptive.optimizer.excludedRules"
    before = spark.conf.get(key, None)
    rule = "org.apache.spark.sql.execution.adaptive.AQEPropagateEmptyRelation"
    spark.conf.set(key, f"{before},{rule}" if before else rule)
    try:
        yield
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


class Pulled(NamedTuple):
    """What one run read and kept, as the engine counted it while writing."""

    fetched: int
    stored: int
    size: int  # of the fetched rows as JSON
    latest: str | None  # text of the fetched rows' latest time


def collect_one(spark: SparkSession, query: LogQuery, state: DataFrame | None, path: str, as_of: datetime | str) -> Pulled:
    """Bring one dataset up to date.

    Every run follows one rule: of the fetched rows the first of each key is stored, unless a stored row inside the
    window has that key. Expired rows hide nothing, and the folders of expired days are deleted. Keys are stored next to
    the rows, so of the history only the keys and times of days inside the window are read. A pull is read once: its
    rows, bytes and latest time are observed on the way into the dataset.
    """
    known = None if state is None else states.get(merge.next_windows(state, as_of), query.title).first()
    dataset = f"{path}/data/{query.title}"
    stored_before = _exists(spark, dataset)
    days = query.window_days if known is None or not stored_before else known.next_days
    pull = extract(query, as_of, days)
    times = time_fields(query, pull)
    at, raw = merge.event_instant(pull, times), merge.first_truthy(pull, times)
    read, written = Observation(), Observation()
    seen = pull.observe(
        read,
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum(record_size(pull).cast("bigint")), F.lit(0)).alias("size"),
        F.max_by(F.when(at.isNotNull(), raw), F.struct(at.alias("at"), raw.alias("raw"))).alias("latest"),
    )
    keyed = seen.withColumns({ROW_ID: merge.identity(pull, query.key_fields), ROW_TIME: at})
    ties = [F.xxhash64(*[c(n) for n in pull.columns])]
    fresh = merge.keep_first(keyed, F.col(ROW_ID), ties)
    if stored_before:
        keys = spark.read.schema(f"{ROW_ID} string, {DAY} date, {ROW_AT} timestamp_ntz").parquet(dataset)
        since = timefeat.moment(as_of) - F.make_dt_interval(F.lit(query.window_days))
        inside = keys.where(F.col(DAY).isNull() | (F.col(DAY) >= first_day(as_of, query.window_days)))
        inside = inside.where(F.col(ROW_AT).isNull() | (F.col(ROW_AT) >= since))
        fresh = fresh.join(inside.select(ROW_ID), ROW_ID, "left_anti")
    kept = fresh.withColumn(ROW_AT, F.col(ROW_TIME)).observe(written, F.count(F.lit(1)).alias("rows"))
    with observed_whole(spark):
        write_days(kept, query, path)
    drop_expired(spark, query, path, as_of)
    return Pulled(read.get["rows"], written.get["rows"], read.get["size"], read.get["latest"])


def collect_all(
    spark: SparkSession, queries: list[LogQuery], path: str, as_of: datetime | str
) -> DataFrame:
    """Run every query and return one row per title: rows in the dataset, latest time, speed and error, and what the run
    itself fetched, stored and read in bytes.

    A failing query counts 0 rows and does not stop the others.
    """
    state_path = f"{path}/state"
    known = states.load(spark, state_path) if _exists(spark, state_path) else None
    rows = []
    for query in queries:
        start = time.perf_counter()
        try:
            pulled = collect_one(spark, query, known, path, as_of)
            count = read_collected(spark, query, path, as_of).count()
            # a run that fetched nothing leaves the state as it was
            latest = (pulled.latest or states.stamp(as_of)) if pulled.fetched else None
            counts = (pulled.fetched, pulled.stored, pulled.size)
            rows.append((query.title, query.window_days, count, latest, time.perf_counter() - start, None, *counts))
        except Exception as problem:  # noqa: BLE001 - reported per title
            rows.append((query.title, query.window_days, 0, None, time.perf_counter() - start, str(problem), 0, 0, 0))
    report = spark.createDataFrame(
        rows,
        "title string, window_days int, n_logs bigint, latest_timestamp string, seconds double, error string,"
        " fetched bigint, stored bigint, bytes bigint",
    ).withColumn("rate", rate_label(F.col("n_logs"), F.col("seconds")))
    done = report.where("error IS NULL AND latest_timestamp IS NOT NULL")
    base = states.initial(done, as_of)
    if known is not None:
        base = known.unionByName(base.join(known, "title", "left_anti"))
    fresh = states.after_run(base, done.select("title", "n_logs", "latest_timestamp"), as_of)
    states.save(states.upsert(base, fresh), state_path)
    return report


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path)
        return True
    except AnalysisException:  # missing or empty folder
        return False
