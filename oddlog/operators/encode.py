"""Encoders and scalers: fitted from the profile tables, applied by map-side lookups.

Every feature of a model owns a slot. All log types share the slots, so a table of mixed log types is encoded with one
lookup per slot however many models there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.names import c
from ..session import BROADCAST_BYTES, plan_bytes
from .profile import as_number, as_text

UNKNOWN = "unknown"
# lookups up to this size are broadcast, larger ones are joined by shuffle
LOOKUP_ROWS = 5_000_000
LOOKUP_BYTES = 128 << 20


def fit_values(selected: DataFrame, counts: DataFrame, by: list[str]) -> DataFrame:
    """(key, slot, feature, value, code, cnt): label codes in code-point order together with training counts.

    A category with gaps also owns the class ``unknown``. Values of complete booleans have counts but no code.
    """
    keys = [*by, "feature"]
    wanted = selected.where(F.col("is_category") | (F.col("type") == "categorical")).select(
        *[c(k) for k in keys], "slot", "is_category", (F.col("non_null") < F.col("rows")).alias("gaps")
    )
    few = F.broadcast(wanted) if plan_bytes(selected) <= BROADCAST_BYTES else wanted
    known = counts.join(few, keys).select(*[c(k) for k in keys], "slot", "is_category", "value", "cnt")
    filler = wanted.where("is_category AND gaps").select(
        *[c(k) for k in keys], "slot", "is_category", F.lit(UNKNOWN).alias("value"), F.lit(0).cast("bigint").alias("cnt")
    )
    values = (
        known.unionByName(filler)
        .groupBy(*[c(k) for k in keys], "slot", "is_category", "value")
        .agg(F.sum("cnt").alias("cnt"))
    )
    order = Window.partitionBy(*[c(k) for k in keys]).orderBy("value")
    code = F.when(F.col("is_category"), F.row_number().over(order) - 1)
    return values.select(*[c(k) for k in by], "slot", "feature", "value", code.alias("code"), "cnt")


def fit_scalers(selected: DataFrame) -> DataFrame:
    """Add ``scale_mean`` and ``scale_std`` of the median-imputed values of numerical model columns.

    The moments after imputation follow from the moments before it, so no second pass over the data is needed. A
    complete boolean needs no imputation. A constant column is divided by 1.
    """
    share = F.col("non_null") / F.col("rows")
    filled = F.coalesce(F.col("median"), F.col("raw_mean"))
    mean = share * F.col("raw_mean") + (1 - share) * filled
    variance = share * (F.pow("raw_std_pop", F.lit(2)) + F.pow(F.col("raw_mean") - mean, F.lit(2))) + (
        1 - share
    ) * F.pow(filled - mean, F.lit(2))
    deviation = F.sqrt(variance)
    number = ~F.col("is_category")
    return selected.withColumns(
        {
            "scale_mean": F.when(number, mean),
            "scale_std": F.when(number, F.when(deviation > 0, deviation).otherwise(1.0)),
            "fill_median": F.when(number, filled),
        }
    )


def unknown_codes(values: DataFrame) -> DataFrame:
    """Code of the class ``unknown`` per (log type, slot), where it exists."""
    return values.where((F.col("value") == UNKNOWN) & F.col("code").isNotNull()).select(
        "log_type", "slot", F.col("code").alias("unknown_code")
    )


def impute(value: Column, fill: Column) -> Column:
    return F.coalesce(value, fill)


def scale(value: Column, mean: Column, std: Column) -> Column:
    return (value - mean) / std


def label_code(code: Column, unknown_code: Column) -> Column:
    """Known value: its code; else the code of ``unknown``; else the first class."""
    return F.coalesce(code, unknown_code, F.lit(0))


def slot_column(df: DataFrame, log_type: str, plan: list[tuple[str, str]], form) -> Column:
    """The slot's source value per row: ``plan`` pairs each log type with the feature it keeps in the slot."""
    by_feature: dict[str, list[str]] = {}
    for kind, feature in plan:
        if feature in df.columns:
            by_feature.setdefault(feature, []).append(kind)
    picked = None
    for feature, types in by_feature.items():
        hit = c(log_type).isin(types)
        picked = F.when(hit, form(df, feature)) if picked is None else picked.when(hit, form(df, feature))
    return picked if picked is not None else F.lit(None)


def text_slot(df: DataFrame, log_type: str, plan: list[tuple[str, str]]) -> Column:
    return slot_column(df, log_type, plan, as_text).cast("string")


def number_slot(df: DataFrame, log_type: str, plan: list[tuple[str, str]]) -> Column:
    return slot_column(df, log_type, plan, as_number).cast("double")


def lookup(df: DataFrame, log_type: str, text: Column, table: DataFrame, slot: int, small: bool) -> DataFrame:
    """Left join of one slot's value table; adds ``code_<slot>`` and ``cnt_<slot>``.

    A small table is broadcast, so events stay where they are. A larger one is joined by shuffle, where adaptive
    execution splits hot values.
    """
    part = table.where(F.col("slot") == slot).select(
        c("log_type").alias("_type"),
        F.col("value").alias("_value"),
        F.col("code").alias(f"code_{slot}"),
        F.col("cnt").alias(f"cnt_{slot}"),
    )
    side = F.broadcast(part) if small else part
    joined = df.join(side, (c(log_type) == F.col("_type")) & (text == F.col("_value")), "left")
    return joined.drop("_type", "_value")
