"""Exact quantiles of any number of groups without sorting a group in one task.

The built-in exact percentile keeps every distinct value of a group in one aggregation buffer, which a continuous
field of a large log does not fit. Here the rank is narrowed by counting instead: a first pass counts rows per
logarithmic bucket; as long as a bucket that holds a wanted rank has too many rows, a further pass counts equal-width
slices of it; at last only the rows of the chosen cells are looked at value by value. Every pass is a map-side-combined
count, so what is shuffled is a few thousand counters per group, whatever the number of rows, and hot values cost
nothing extra. The cell functions only have to be monotone, so rounding in them cannot change the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import join_side

STEPS_PER_E = 512
SLICES = 4096
EDGE = 400_000  # beyond the bucket of the largest finite double (ln(1.8e308) * 512)
CELL_ROWS = 1_000_000  # cells with more rows are sliced again, unless they hold a single value


def _log_bucket(v: Column) -> Column:
    scaled = F.signum(v) * F.log1p(F.abs(v)) * STEPS_PER_E
    return F.floor(F.greatest(F.least(scaled, F.lit(float(EDGE))), F.lit(float(-EDGE)))).cast("int")


def _slice(v: Column, low: Column, high: Column) -> Column:
    """Equal-width slice of ``v`` in [low, high]; infinite bounds stay one slice."""
    share = (v - low) / (high - low)
    cut = F.least(F.floor(share * SLICES), F.lit(SLICES - 1)).cast("int")
    return F.when((high > low) & (high - low < float("inf")), cut).otherwise(F.lit(0))


def _holding(hist: DataFrame, within: list[str], order: str) -> DataFrame:
    """Rows of a histogram that hold a wanted rank: ``wanted`` shrinks to those, ``start`` is the count before them."""
    return (
        hist.withColumn("upto", F.sum("n").over(Window.partitionBy(*within).orderBy(order)) + F.col("start"))
        .withColumn("wanted", F.expr("filter(wanted, r -> r >= upto - n AND r < upto)"))
        .where("size(wanted) > 0")
        .withColumn("start", F.col("upto") - F.col("n"))
        .drop("upto")
    )


def _chosen(hist: DataFrame, within: list[str], place: list[str]) -> DataFrame:
    return join_side(_holding(hist, within, place[-1]), "quantile-cells")


def exact_quantiles(
    values: DataFrame, keys: list[str], probabilities: dict[str, float], value: str = "value"
) -> DataFrame:
    """One row per key group with a column per named probability, linearly interpolated; nulls and NaN are ignored.

    The list of chosen cells holds at most two rows per probability and key group. It is written to the work folder as
    it is found, and broadcast if that makes few rows in total.
    """
    rows = values.select(*keys, F.col(value).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    rows, place = rows.withColumn("cell_0", _log_bucket(F.col("v"))), [*keys, "cell_0"]

    def counted(df: DataFrame) -> DataFrame:
        # plain numbers only, so the large aggregates are hash aggregates; ranks are joined to their small results
        return df.groupBy(*place).agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))

    total = F.sum("n").over(Window.partitionBy(*keys))
    positions = [F.lit(p) * (F.col("total") - 1) for p in probabilities.values()]
    wanted = F.array_distinct(F.array(*[f(p).cast("bigint") for p in positions for f in (F.floor, F.ceil)]))
    hist = counted(rows).withColumn("total", total).withColumns({"wanted": wanted, "start": F.lit(0)})
    cells = _chosen(hist, keys, place)
    while cells.where((F.col("n") > CELL_ROWS) & (F.col("high") > F.col("low"))).count():
        rows = rows.join(cells.select(*place, "low", "high"), place).withColumn(
            f"cell_{len(place)}", _slice(F.col("v"), F.col("low"), F.col("high"))
        )
        parents, within = cells.select(*place, "total", "wanted", "start"), place
        place = [*place, f"cell_{len(place)}"]
        rows = rows.drop("low", "high")
        cells = _chosen(counted(rows).join(parents, within), within, place)

    exact = (
        rows.join(cells.select(*place), place)
        .groupBy(*place, "v")
        .agg(F.count(F.lit(1)).alias("n"))
        .join(cells.select(*place, "total", "wanted", "start"), place)
    )
    found = _holding(exact, place, "v").select(*keys, "total", "v", F.explode("wanted").alias("rank"))

    picked = []
    for name, p in probabilities.items():
        position = F.lit(p) * (F.col("total") - 1)
        low = F.max(F.when(F.col("rank") == F.floor(position), F.col("v")))
        high = F.max(F.when(F.col("rank") == F.ceil(position), F.col("v")))
        share = F.max(position - F.floor(position))
        # equal ends are returned as they are, so infinities do not turn into NaN
        picked.append(F.when(low == high, low).otherwise(low + (high - low) * share).alias(name))
    return found.groupBy(*keys).agg(*picked)
