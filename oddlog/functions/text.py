"""Canonical text forms and number labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T


def canonical_text(col: Column, dtype: T.DataType) -> Column:
    """One text form per value, used on the training and on the event side alike.

    Booleans read ``True``/``False``; a floating value without fraction prints as an integer, so a port that became
    floating because of missing values still matches.
    """
    if isinstance(dtype, T.StringType):
        return col
    if isinstance(dtype, T.BooleanType):
        return F.initcap(col.cast("string"))
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        whole = (F.abs(col) < F.lit(1e15)) & (F.floor(col) == col)
        return F.when(whole, F.floor(col).cast("bigint").cast("string")).otherwise(col.cast("string"))
    if isinstance(dtype, T.VariantType):
        return F.to_json(col)
    return col.cast("string")


def truthy(col: Column, dtype: T.DataType) -> Column:
    """Text of ``col`` with empty strings, zeros and nulls turned to null, for first-present lookups."""
    if isinstance(dtype, T.StringType):
        return F.nullif(col, F.lit(""))
    if isinstance(dtype, T.NumericType):
        return F.when(col != 0, canonical_text(col, dtype))
    return canonical_text(col, dtype)


def fixed(col: Column, digits: int) -> Column:
    """``col`` with a fixed number of decimals, rounded half up on its decimal form."""
    rounded = F.round(col.try_cast("decimal(30,10)"), digits).cast(f"decimal(30,{digits})")
    return F.coalesce(rounded.cast("string"), col.cast("string"))


def count_label(n: Column) -> Column:
    """``1.2M`` / ``3.4k`` / plain count."""
    return (
        F.when(n >= 1_000_000, F.concat(fixed(n / 1_000_000, 1), F.lit("M")))
        .when(n >= 1_000, F.concat(fixed(n / 1_000, 1), F.lit("k")))
        .otherwise(n.cast("bigint").cast("string"))
    )


def progress_label(n: Column) -> Column:
    """Count of collected rows as shown next to the estimate: millions, otherwise always thousands."""
    return F.when(n >= 1_000_000, F.concat(fixed(n / 1_000_000, 1), F.lit("M"))).otherwise(
        F.concat(fixed(n / 1_000, 1), F.lit("k"))
    )


def rate_label(rows: Column, seconds: Column) -> Column:
    """Events per minute as text; a run without elapsed time is still being measured."""
    per_minute = rows / F.nullif(seconds, F.lit(0.0)) * 60
    text = (
        F.when(per_minute >= 1_000_000, F.concat(fixed(per_minute / 1_000_000, 1), F.lit("M events/min")))
        .when(per_minute >= 1_000, F.concat(fixed(per_minute / 1_000, 1), F.lit("k events/min")))
        .otherwise(F.concat(fixed(per_minute, 0), F.lit(" events/min")))
    )
    return F.when(seconds > 0, text).otherwise(F.lit("calculating..."))


def eta_label(seconds: Column, percent: Column) -> Column:
    """Remaining time from elapsed seconds and progress in percent."""
    left = seconds * (100 - percent) / F.nullif(percent, F.lit(0.0))
    text = (
        F.when(left > 3600, F.concat(fixed(left / 3600, 1), F.lit(" hours")))
        .when(left > 60, F.concat(fixed(left / 60, 0), F.lit(" minutes")))
        .otherwise(F.concat(fixed(left, 0), F.lit(" seconds")))
    )
    return (
        F.when(seconds <= 0, F.lit("calculating..."))
        .when((percent > 0) & (percent < 100), text)
        .otherwise(F.lit("unknown"))
    )
