"""Time features and instants from log timestamps.

Two readings of one string, never mixed: features use the wall clock written in the string, windows and retention use
the instant it denotes. Both are TIMESTAMP_NTZ values (the instant in UTC), so no result depends on the session zone.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, functions as F, types as T

OFFSET = r"([+-])(\d{2}):?(\d{2})$"


def wall_clock(col: Column, dtype: T.DataType) -> Column:
    """The date and time as written, null when unparseable. Numbers are not read as epochs.

    A timestamp with a zone has none written; it is read in UTC, whatever the session's zone.
    """
    if isinstance(dtype, T.TimestampType):
        return F.convert_timezone(F.current_timezone(), F.lit("UTC"), col.cast("timestamp_ntz"))
    if isinstance(dtype, (T.TimestampNTZType, T.DateType)):
        return col.cast("timestamp_ntz")
    if isinstance(dtype, T.StringType):
        return col.try_cast("timestamp_ntz")
    return F.lit(None).cast("timestamp_ntz")


def instant(col: Column, dtype: T.DataType) -> Column:
    """The UTC instant; text without an offset is taken as UTC."""
    local = wall_clock(col, dtype)
    if not isinstance(dtype, T.StringType):
        return local
    sign = F.when(F.regexp_extract(col, OFFSET, 1) == "-", F.lit(-1)).otherwise(F.lit(1))
    hours = F.regexp_extract(col, OFFSET, 2).try_cast("int")
    minutes = F.regexp_extract(col, OFFSET, 3).try_cast("int")
    shift = F.make_dt_interval(hours=sign * hours, mins=sign * minutes)
    has_offset = col.rlike(r"\d:\d.*" + OFFSET)
    return F.when(has_offset, local - shift).otherwise(local)


def moment(as_of: datetime | str) -> Column:
    """A fixed point in time given by the caller; jobs never read the clock themselves."""
    text = as_of.strftime("%Y-%m-%d %H:%M:%S.%f") if isinstance(as_of, datetime) else as_of
    return F.lit(text).cast("timestamp_ntz")


def first_present(fields: list[Column]) -> Column:
    """First non-null of the time fields in order."""
    return F.coalesce(*fields)


def _feature(source: Column, dtype: T.DataType, value) -> Column:
    parsed = wall_clock(source, dtype)
    missing = source.isNull()
    if isinstance(dtype, T.StringType):
        missing = missing | (F.trim(source) == "")
    return F.when(missing, F.lit(None).cast("int")).when(parsed.isNull(), F.lit(-1)).otherwise(value(parsed))


def hour(source: Column, dtype: T.DataType = T.StringType()) -> Column:
    """Hour in the string's own offset; -1 when unparseable, null when there is no time."""
    return _feature(source, dtype, F.hour)


def day_of_week(source: Column, dtype: T.DataType = T.StringType()) -> Column:
    """Monday = 0; -1 and null as for :func:`hour`."""
    return _feature(source, dtype, F.weekday)


def days_between(later: Column, earlier: Column) -> Column:
    """Difference in days with fraction."""
    return seconds_between(later, earlier) / 86400


def seconds_between(later: Column, earlier: Column) -> Column:
    """Difference of two wall clocks in seconds; no time zone is involved."""
    gap = later - earlier
    parts = [("DAY", 86400), ("HOUR", 3600), ("MINUTE", 60), ("SECOND", 1)]
    return sum((F.extract(F.lit(unit), gap).cast("double") * size for unit, size in parts), F.lit(0.0))


def window_days(last_seen: Column, as_of: Column, configured: Column) -> Column:
    """Days to fetch next: whole days since the last seen event plus one, between 1 and the configured window."""
    needed = F.floor(days_between(as_of, last_seen)).cast("int") + 1
    return F.when(last_seen.isNull(), configured).otherwise(F.least(F.greatest(F.lit(1), needed), configured))


def range_label(first: Column, last: Column) -> Column:
    return F.concat(F.date_format(first, "MM/dd HH:mm"), F.lit(" to "), F.date_format(last, "MM/dd HH:mm"))
