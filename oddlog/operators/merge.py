"""Incremental ingest: union, keep-first de-duplication, retention, and what to fetch next."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions import timefeat
from ..functions.names import IDENTITY_FIELDS, TIME_FIELDS_INGEST, c
from ..functions.text import truthy
from ..session import join_side, stage

RECENT_ROWS = 1000  # fixed value: rows the density estimate looks at
SHARES = 64


def first_truthy(df: DataFrame, fields: tuple[str, ...]) -> Column:
    """First field that is neither null, empty nor zero, as text."""
    found = [truthy(c(f), df.schema[f].dataType) for f in fields if f in df.columns]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def identity(df: DataFrame, fields: tuple[str, ...] = IDENTITY_FIELDS, whole_row: bool = True) -> Column:
    """De-duplication key: first truthy identity field, named so that an id never equals a timestamp; else the row.

    A zero gives way to any other identity field, but where it is the only one it is the id. The row form is a digest of
    the whole record as JSON, nothing is cut off. Logs that always carry an identity field do without it
    (``whole_row=False``); then only the identity fields are read.
    """
    there = [f for f in fields if f in df.columns]
    named = [F.concat(F.lit(f"{f}="), truthy(c(f), df.schema[f].dataType)) for f in there]
    numbers = [f for f in there if isinstance(df.schema[f].dataType, T.NumericType)]
    named += [F.when(c(f) == 0, F.lit(f"{f}=0")) for f in numbers]
    if named and not whole_row:
        return F.coalesce(*named)
    whole = F.concat(F.lit("row="), F.sha2(F.to_json(F.struct(*[c(n) for n in sorted(df.columns)])), 256))
    return F.coalesce(*named, whole)


def union_logs(existing: DataFrame, new: DataFrame, rank: str = "src_rank") -> DataFrame:
    """Existing rows (rank 0) and new rows (rank 1); a column one side lacks is null there."""
    return existing.withColumn(rank, F.lit(0)).unionByName(new.withColumn(rank, F.lit(1)), allowMissingColumns=True)


def keep_first(df: DataFrame, key: Column, order: list) -> DataFrame:
    """One row per key, the first in ``order``.

    The rank limit is pushed below the shuffle, so every task sends at most one row per key: a key that holds a third
    of all rows still shuffles one row per task.
    """
    window = Window.partitionBy("_key").orderBy(*order)
    return (
        df.withColumn("_key", key)
        .withColumn("_place", F.row_number().over(window))
        .where(F.col("_place") == 1)
        .drop("_key", "_place")
    )


def event_instant(df: DataFrame, fields: tuple[str, ...] = TIME_FIELDS_INGEST) -> Column:
    """UTC instant of the first truthy time field; null when absent or unparseable."""
    found = [f for f in fields if f in df.columns]
    if len(found) == 1 or (found and len({df.schema[f].dataType for f in found}) == 1):
        dtype = df.schema[found[0]].dataType
        picked = [F.nullif(c(f), F.lit("")) if dtype.simpleString() == "string" else c(f) for f in found]
        return timefeat.instant(F.coalesce(*picked), dtype)
    return timefeat.instant(first_truthy(df, fields), T.StringType())


def retain(df: DataFrame, as_of: datetime | str, window_days: int, fields: tuple[str, ...] = TIME_FIELDS_INGEST) -> DataFrame:
    """Rows not older than ``window_days`` before ``as_of``; rows without a readable time are kept."""
    when = event_instant(df, fields)
    cutoff = timefeat.moment(as_of) - F.make_dt_interval(F.lit(window_days))
    return df.where(when.isNull() | (when >= cutoff))


def occurs_since(df: DataFrame, as_of: datetime | str, days: int, field: str = "p_event_time") -> DataFrame:
    """Trailing window on one time field; rows without a time are outside.

    A native timestamp column is compared as it is, so the filter reaches the Parquet scan.
    """
    cutoff = timefeat.moment(as_of) - F.make_dt_interval(F.lit(days))
    return df.where(timefeat.instant(c(field), df.schema[field].dataType) >= cutoff)


def merge_incremental(
    existing: DataFrame,
    new: DataFrame,
    as_of: datetime | str,
    window_days: int,
    key_fields: tuple[str, ...] = IDENTITY_FIELDS,
    time_fields: tuple[str, ...] = TIME_FIELDS_INGEST,
    order: list | None = None,
    existing_unique: bool = False,
) -> DataFrame:
    """Existing plus new rows, first occurrence per key, inside the retention window.

    ``order`` decides between rows of one side with the same key; existing rows always win over new ones. The window
    cannot be applied before de-duplication: an expired first copy also hides a later one. Rows that came out of an
    earlier merge are unique; saying so spares shuffling them, see :func:`unseen`.
    """
    if existing_unique:
        merged = existing.unionByName(unseen(existing, new, key_fields, order), allowMissingColumns=True)
        return retain(merged, as_of, window_days, time_fields)
    both = union_logs(existing, new)
    data = [n for n in both.columns if n != "src_rank"]
    ties = order or [F.xxhash64(*[c(n) for n in data])]
    merged = keep_first(both, identity(both.select(*[c(n) for n in data]), key_fields), ["src_rank", *ties])
    return retain(merged.drop("src_rank"), as_of, window_days, time_fields)


def unseen(
    existing: DataFrame,
    new: DataFrame,
    key_fields: tuple[str, ...] = IDENTITY_FIELDS,
    order: list | None = None,
    whole_row: bool = True,
) -> DataFrame:
    """New rows whose key is not among the existing ones, once per key.

    The existing rows are only looked through for the keys of the new batch. While that batch is small its keys are
    broadcast, so the stored log is neither shuffled nor sorted; a large batch is joined by shuffle. Both sides must
    have the same columns for rows without any identity field to be recognised.
    """
    ties = order or [F.xxhash64(*[c(n) for n in new.columns])]
    keyed = new.withColumn("_id", identity(new, key_fields, whole_row))
    fresh = stage(keep_first(keyed, F.col("_id"), ties), "fresh")
    wanted = join_side(fresh.select("_id"), "fresh-keys")
    stored = existing.select(identity(existing, key_fields, whole_row).alias("_id"))
    seen = join_side(stored.join(wanted, "_id", "left_semi").distinct(), "seen-keys")
    return fresh.join(seen, "_id", "left_anti").drop("_id")


def latest_timestamp(df: DataFrame, by: list[str], as_of: datetime | str, fields: tuple[str, ...] = TIME_FIELDS_INGEST) -> DataFrame:
    """Per group the raw text of the latest readable time, or ``as_of`` when there is none."""
    keys = [c(k) for k in by]
    timed = df.select(*keys, first_truthy(df, fields).alias("raw"), event_instant(df, fields).alias("at"))
    fallback = F.concat(F.date_format(timefeat.moment(as_of), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    # instants are compared first: a hash aggregate of plain numbers, where one over texts would sort every task's rows
    best = timed.groupBy(*keys).agg(F.max("at").alias("at"))
    if by:
        at_best = timed.join(join_side(best, "latest"), [*by, "at"])
        texts = at_best.groupBy(*keys).agg(F.max("raw").alias("raw"))
        found = best.select(*keys).join(texts, by, "left")
    else:
        found = timed.agg(F.max_by(F.when(F.col("at").isNotNull(), F.col("raw")), F.struct("at", "raw")).alias("raw"))
    return found.select(*keys, F.coalesce("raw", fallback).alias("latest_timestamp"))


def density(
    df: DataFrame,
    by: list[str],
    window_days: int,
    order: list,
    fields: tuple[str, ...] = TIME_FIELDS_INGEST,
    groups: DataFrame | None = None,
) -> DataFrame:
    """Per group: rows, estimated total for the window, progress in percent and the time range looked at.

    The estimate uses the last 1000 rows in ``order``, found in two steps: of each group and share of the tasks, then of
    the group. The last step sees at most 1000 rows for each of the ``SHARES``, however many tasks there are. ``groups``
    names groups that must have a row; without rows they read 0, 0 and "No data", as does an empty log without ``by``.
    """
    keys = [c(k) for k in by]
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("current_count"))
    latest_first = [o.desc() if isinstance(o, Column) else F.desc(o) for o in order]
    recent = df.withColumn("_at", event_instant(df, fields)).withColumn("_share", F.spark_partition_id() % SHARES)
    for level in (["_share"], []):
        window = Window.partitionBy(*keys, *level, F.lit(0)).orderBy(*latest_first)
        recent = recent.withColumn("_place", F.row_number().over(window)).where(F.col("_place") <= RECENT_ROWS)
    recent = recent.groupBy(*keys).agg(
        F.count("_at").alias("timed"), F.min("_at").alias("first"), F.max("_at").alias("last")
    )
    joined = counts.join(recent, by) if by else counts.crossJoin(recent)  # without keys each side is one row
    if groups is not None:
        joined = groups.select(*keys).join(joined, by, "left")
    count = F.coalesce(F.col("current_count"), F.lit(0))
    span = F.greatest(F.lit(0.1), timefeat.days_between(F.col("last"), F.col("first")))
    expected = F.floor(F.col("timed") / span * window_days).cast("bigint")
    enough = F.coalesce(F.col("timed") >= 2, F.lit(False))
    total = F.when(enough, F.greatest(count, expected)).otherwise(count * 2)
    progress = F.when(enough, F.least(F.lit(100.0), count / F.when(enough, total) * 100)).otherwise(50.0)
    return joined.select(
        *keys,
        count.alias("current_count"),
        total.alias("estimated_total"),
        F.when(count == 0, 0.0).otherwise(progress).alias("progress_pct"),
        F.when(count == 0, "No data")
        .when(enough, timefeat.range_label(F.col("first"), F.col("last")))
        .otherwise("Insufficient timestamp data for estimation")
        .alias("time_range"),
    )


def next_windows(state: DataFrame, as_of: datetime | str) -> DataFrame:
    """Add ``next_days``: how many days the next run has to fetch for every title in the state table."""
    last = timefeat.instant(F.col("last_data_timestamp"), state.schema["last_data_timestamp"].dataType)
    return state.withColumn("next_days", timefeat.window_days(last, timefeat.moment(as_of), F.col("window_days")))
