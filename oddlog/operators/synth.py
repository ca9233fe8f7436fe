"""Synthetic events drawn from a model's baseline, normal or anomalous; deterministic by seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.names import c
from ..session import join_side
from ..sources.models import Model

ANOMALY_CHANCE = 0.7  # fixed value: share of an anomalous event's features that are unusual
TABLE_ROWS = 10_000  # draw tables broadcast up to this many rows of at most 1000 values each


def uniform(seed: int, ident: Column, feature: Column, purpose: str) -> Column:
    """A number in [0, 1) from the first 32 bits of an md5 over seed, event, feature and purpose."""
    text = F.concat_ws(":", F.lit(str(seed)), ident.cast("string"), feature, F.lit(purpose))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 4294967296.0


def rare_values(counts: DataFrame, by: list[str]) -> DataFrame:
    """The least frequent tenth of each feature's values, at least one; groups are value lists of at most 1000."""
    keys = [c(k) for k in by]
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("cnt", "value"))
    limit = F.greatest(F.lit(1), F.floor(F.count("value").over(Window.partitionBy(*keys)) / 10))
    return counts.withColumns({"place": place, "keep": limit}).where("place <= keep").drop("keep")


def draw_tables(model: Model) -> DataFrame:
    """One row per (log type, feature): statistics, and for categories values with running counts and the rare ones."""
    counts = model.values.where("cnt > 0").select("log_type", "feature", "value", "cnt")
    by = ["log_type", "feature"]
    running = F.sum("cnt").over(Window.partitionBy(*by).orderBy("value"))
    common = (
        counts.withColumn("upto", running)
        .groupBy(*by)
        .agg(F.sort_array(F.collect_list(F.struct("upto", "value"))).alias("ladder"))
    )
    rare = (
        rare_values(counts, by)
        .groupBy(*by)
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "value"))), lambda e: e["value"]).alias("rare"))
    )
    stats = model.features.select(*by, "slot", "type", "mean", "std")
    return stats.join(common, by, "left").join(rare, by, "left")


def synthesise(ids: DataFrame, model: Model, ident: str = "id", anomalous: str = "anomalous", seed: int = 42) -> DataFrame:
    """Long table (id, log_type, anomalous, feature, value) with one row per event and feature.

    ``ids`` holds one row per event to make: its id, ``log_type`` and whether it is to be anomalous. The draw tables
    have at most ten rows per log type and 1000 values per row, and each value is found by a search in the ladder rather
    than by joining events to values.
    """
    rows = ids.select(c(ident).alias("id"), "log_type", c(anomalous).alias("anomalous")).join(
        join_side(draw_tables(model), "draw-tables", TABLE_ROWS), "log_type"
    )
    odd = F.col("anomalous") & (uniform(seed, F.col("id"), F.col("feature"), "odd") < ANOMALY_CHANCE)
    pick = uniform(seed, F.col("id"), F.col("feature"), "pick")
    side = uniform(seed, F.col("id"), F.col("feature"), "side")

    target = F.floor(pick * F.element_at("ladder", -1)["upto"]).cast("bigint")
    common = F.get(F.filter("ladder", lambda e: e["upto"] > F.col("target")), F.lit(0))["value"]
    rare = F.get("rare", F.floor(pick * F.size("rare")).cast("int"))
    multiplier = F.when(
        F.col("odd"), F.when(side < 0.5, F.lit(-1.0)).otherwise(F.lit(1.0)) * (3 + pick * 2)
    ).otherwise(pick * 4 - 2)
    number = F.col("mean") + F.col("std") * multiplier
    name = F.col("feature")
    amount = name.endswith("Count") | F.lower(name).contains("packets") | F.lower(name).contains("bytes")
    whole = F.when(number < 0, F.ceil(number)).otherwise(F.floor(number)).cast("double")
    bounded = (
        F.when(name == "hour", F.greatest(F.lit(0.0), F.least(F.lit(23.0), whole)))
        .when(name == "day_of_week", F.greatest(F.lit(0.0), F.least(F.lit(6.0), whole)))
        .when(amount, F.greatest(F.lit(0.0), whole))
        .otherwise(number)
    )
    category = F.col("type") == "categorical"
    return rows.withColumns({"odd": odd, "target": F.when(category, target)}).select(
        "id",
        "log_type",
        "anomalous",
        "feature",
        F.when(category, F.when(F.col("odd"), rare).otherwise(common)).alias("text_value"),
        F.when(~category, bounded).alias("number_value"),
    )
