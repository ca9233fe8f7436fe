"""Keyed ingest on a stream: the first event of every key passes, keys are forgotten again, late events are counted."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators import merge

DAY_MS = 86_400_000
BUCKETS = 1 << 13  # states that the keys are dealt over; a checkpoint is bound to it
READ, JUDGED = "events_read", "events_judged"  # names of the observations
COUNTS = "batch_id bigint, read bigint, late bigint, duplicates bigint, passed bigint"


def fold_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the rows of a batch with one key and day the first, with the number of rows it stands for.

    What is shuffled of a key that holds a third of all rows is then one row per batch and day.
    """
    for rows in batches:
        part = rows.select(["log_id", "_day", "_order"]).to_pandas()
        part = part.sort_values("_order", kind="stable")
        group = part.groupby(["log_id", "_day"], dropna=False, sort=False)["_order"]
        part["_rows"] = group.transform("size")
        first = part[group.cumcount() == 0]
        kept = rows.take(pa.array(first.index.to_numpy()))
        yield kept.append_column("_rows", pa.array(first["_rows"].to_numpy(), pa.int64()))


class FirstOfKey(StatefulProcessor):
    """Remembers the day on which a key last passed; an event passes unless it lies within the window of that day.

    The keys of a bucket are one state, as every call to the state store costs a round trip from Python. A timer at the
    earliest of its ends forgets days once no event within their window can come any more. It never decides what passes:
    an event that is in time and arrives after the timer lies outside the window anyway.
    """

    def __init__(self, window_days: int):
        self.window = window_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "keys array<string>, days array<int>")

    def handleInputRows(self, key, rows, timerValues):
        judged, passed = 0, []
        last = self.remembered()
        before = min(last.values(), default=None)
        now = timerValues.getCurrentWatermarkInMs() // DAY_MS
        dated = [(row["log_id"], now if row["_day"] is None else row["_day"], row["_order"], row) for row in rows]
        for log_id, day, _, row in sorted(dated, key=lambda r: r[:3]):
            judged += row["_rows"]
            if log_id not in last or abs(day - last[log_id]) >= self.window:
                last[log_id] = day
                passed.append(row["row"])
        self.remember(last, before, timerValues)
        for row in passed or [None]:
            yield T.Row(row=row, judged=judged)
            judged = 0

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.remember(self.remembered(), None, timerValues)
        return iter(())

    def remembered(self) -> dict[str, int]:
        found = self.last.get()
        return dict(zip(*found)) if found else {}

    def remember(self, last: dict[str, int], before: int | None, timerValues) -> None:
        """Keep what the watermark has not ended, and have the timer, if any at ``before``, at the earliest day."""
        mark = timerValues.getCurrentWatermarkInMs()
        kept = {k: day for k, day in last.items() if (day + self.window) * DAY_MS > mark}
        first = min(kept.values(), default=None)
        if kept:
            self.last.update((list(kept), list(kept.values())))
        else:
            self.last.clear()
        if first != before:
            if before is not None:
                self.handle.deleteTimer((before + self.window) * DAY_MS)
            if first is not None:
                self.handle.registerTimer((first + self.window) * DAY_MS)

    def close(self) -> None:
        pass


def first_of_key(
    events: DataFrame, key: Column, time: Column, window_days: int, late_days: int
) -> DataFrame:
    """Events of a stream, the first of every key; a key may pass again ``window_days`` after the day it passed.

    Days are the unit, as in stored datasets. Within a micro-batch the earliest event of a key is its first, ties are
    broken by a digest of the row. Events of a day that lies more than ``late_days`` before the latest day of earlier
    micro-batches are late: dropped, and counted by :func:`ingest_counts`. ``time`` is a timestamp; events without one
    are never late and count as of the day the watermark has reached (1970-01-01 before it is known). Null keys are one
    key. ``late_days`` must be below ``window_days``, or a key could be forgotten while its copies may still come.
    """
    if not 0 < late_days < window_days:
        raise ValueError("late_days must lie between 0 and window_days")
    at = time.cast("timestamp")
    micros = F.coalesce(F.unix_micros(at), F.lit(0)) + F.lit(1 << 62)
    ties = F.lpad(F.hex(F.xxhash64(*[F.col(f"`{n}`") for n in events.columns])), 16, "0")
    named = events.observe(READ, F.count(F.lit(1)).alias("rows")).select(
        F.coalesce(key.cast("string"), F.lit("")).alias("log_id"),
        F.floor(F.unix_millis(at) / DAY_MS).cast("int").alias("_day"),
        F.concat(F.lpad(micros.cast("string"), 20, "0"), ties).alias("_order"),
        F.struct(*[F.col(f"`{n}`") for n in events.columns]).alias("row"),
    )
    folded_type = T.StructType([*named.schema.fields, T.StructField("_rows", T.LongType())])
    folded = named.mapInArrow(fold_copies, folded_type)
    bucket = F.pmod(F.xxhash64("log_id"), F.lit(BUCKETS)).alias("_bucket")
    timed = folded.select(bucket, "*", F.timestamp_millis(F.col("_day").cast("long") * DAY_MS).alias("_at"))
    out = T.StructType([T.StructField("row", events.schema), T.StructField("judged", T.LongType())])
    judged = (
        timed.withWatermark("_at", f"{late_days} days")
        .groupBy("_bucket")
        .transformWithState(FirstOfKey(window_days), out, "Append", "EventTime")
    )
    counted = judged.observe(
        JUDGED, F.coalesce(F.sum("judged"), F.lit(0)).alias("rows"), F.count("row").alias("passed")
    )
    return counted.where(F.col("row").isNotNull()).select("row.*")


@contextmanager
def rocksdb(spark: SparkSession):
    """Within it, streams start with the state store that timers need, which also keeps state outside the heap."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


def start_ingest(
    events: DataFrame,
    path: str,
    checkpoint: str,
    window_days: int,
    late_days: int,
    key: Column | None = None,
    time: Column | None = None,
    available_now: bool = True,
) -> StreamingQuery:
    """Append the first event of every key to a Parquet dataset, exactly once, over restarts from ``checkpoint``.

    Key and time are those of the batch merge unless given.
    """
    keyed = merge.identity(events) if key is None else key
    timed = merge.event_instant(events) if time is None else time
    fresh = first_of_key(events, keyed, timed, window_days, late_days)
    writer = fresh.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer
    with rocksdb(fresh.sparkSession):
        return writer.start(path)


def ingest_counts(spark: SparkSession, query: StreamingQuery) -> DataFrame:
    """Per micro-batch that the engine remembers: events read, late, duplicates and passed on, as observed on the way."""
    found = []
    for p in query.recentProgress:
        if p.numInputRows:
            read, judged = p.observedMetrics[READ], p.observedMetrics[JUDGED]
            late = read["rows"] - judged["rows"]
            found.append((p.batchId, read["rows"], late, judged["rows"] - judged["passed"], judged["passed"]))
    return spark.createDataFrame(found, COUNTS)
