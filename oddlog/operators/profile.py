"""Column profile of log tables: kinds, counts, moments, quantiles and value counts per log type.

Three steps, each over all columns at once:

1. ``summarise``: one aggregate per block of columns gives counts, moments and an approximate distinct count;
2. columns that can still become features are kept, all others are never read again;
3. value counts (categories) and exact quantiles (numbers) of the kept columns.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.names import c, is_port, is_port_name
from ..functions.scoring import MAX_CARDINALITY, MIN_VARIANCE
from ..functions.text import canonical_text
from ..session import join_side, stage
from .quantiles import exact_quantiles

QUARTILES = {"q25": 0.25, "median": 0.5, "q75": 0.75}
BLOCK = 60  # columns per aggregate; wide logs are read block by block, each column once
SKETCH_BITS = 12
# Distinct counts are exact from value counts. The sketch (standard error 1.6 %) only spares columns far above the
# limit: 1.5 times the limit is 30 standard errors away, so no column within the limit is lost.
APPROX_MARGIN = 1.5


def kind(dtype: T.DataType) -> str:
    """``bool``, ``number`` or ``text``; dates and all other scalars are text."""
    if isinstance(dtype, T.BooleanType):
        return "bool"
    return "number" if isinstance(dtype, T.NumericType) else "text"


def kinds(df: DataFrame, by: list[str]) -> dict[str, str]:
    return {f.name: kind(f.dataType) for f in df.schema.fields if f.name not in by}


def as_number(df: DataFrame, name: str) -> Column:
    """Numeric form used for statistics and the model: booleans are 0/1, text is parsed, NaN is missing."""
    dtype = df.schema[name].dataType
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.nanvl(c(name), F.lit(None)).cast("double")
    if isinstance(dtype, T.BooleanType):
        return c(name).cast("double")
    if isinstance(dtype, T.NumericType):
        return c(name).cast("double")
    return c(name).cast("string").try_cast("double")


def as_text(df: DataFrame, name: str) -> Column:
    return canonical_text(c(name), df.schema[name].dataType)


def summarise(df: DataFrame, by: list[str], columns: list[str] | None = None) -> DataFrame:
    """One row per (key, column): ordinal, kind, rows, non_null, approx_distinct, variance, mean, std, std_pop, min, max."""
    names = columns if columns is not None else [n for n in df.columns if n not in by]
    sketched = [n for n in names if _needs_sketch(df, n)]
    measured = [n for n in names if n not in sketched]
    blocks = [part[i : i + BLOCK] for part in (measured, sketched) for i in range(0, len(part), BLOCK)]
    parts = [_summarise_block(df, by, block, names) for block in blocks]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _needs_sketch(df: DataFrame, name: str) -> bool:
    """Columns that may become categories with many values. They are aggregated apart from the others, because moments
    alone compile to one code-generated aggregate and sketches do not."""
    what = kind(df.schema[name].dataType)
    return what == "text" or (what == "number" and is_port_name(name))


def _summarise_block(df: DataFrame, by: list[str], block: list[str], names: list[str]) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, name in enumerate(block):
        col, what = c(name), kind(df.schema[name].dataType)
        if what != "text":
            col = as_number(df, name)
            aggs += [
                F.avg(col).alias(f"mean_{i}"),
                F.var_pop(col).alias(f"var_pop_{i}"),
                F.min(col).alias(f"min_{i}"),
                F.max(col).alias(f"max_{i}"),
            ]
        aggs.append(F.count(col).alias(f"non_null_{i}"))
        if _needs_sketch(df, name):
            sketch = F.hll_sketch_agg(as_text(df, name).cast("string"), F.lit(SKETCH_BITS))
            aggs.append(F.hll_sketch_estimate(sketch).alias(f"approx_{i}"))
    wide = df.groupBy(*[c(k) for k in by]).agg(*aggs)

    def entry(i: int, name: str) -> Column:
        what = kind(df.schema[name].dataType)

        def number(stat: str) -> Column:
            return F.col(f"{stat}_{i}") if what != "text" else F.lit(None).cast("double")

        # one second moment per column; the sample and population forms follow from it
        spread, n = number("var_pop"), F.col(f"non_null_{i}")
        variance = F.when(n > 1, spread * n / (n - 1))
        approx = F.col(f"approx_{i}") if f"approx_{i}" in wide.columns else F.lit(2 if what == "bool" else None).cast("bigint")
        return F.struct(
            F.lit(name).alias("feature"),
            F.lit(names.index(name)).alias("position"),
            F.lit(what).alias("kind"),
            F.col("rows"),
            F.col(f"non_null_{i}").alias("non_null"),
            approx.alias("approx_distinct"),
            variance.alias("variance"),
            number("mean").alias("mean"),
            F.sqrt(variance).alias("std"),
            F.sqrt(spread).alias("std_pop"),
            number("min").alias("min"),
            number("max").alias("max"),
        )

    return wide.select(*[c(k) for k in by], F.inline(F.array(*[entry(i, n) for i, n in enumerate(block)])))


def value_counts(df: DataFrame, by: list[str], columns: list[str], only: DataFrame | None = None) -> DataFrame:
    """(key, feature, value, cnt) for every non-null value, complete; ``only`` names the (key, feature) pairs wanted.

    All columns are counted in one unpivoted aggregate; partial counts are combined before the shuffle, so a value
    that fills a third of the table costs one row per task.
    """
    if not columns:
        keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in by)
        return df.sparkSession.createDataFrame([], (keys + ", " if keys else "") + "feature string, value string, cnt bigint")
    text = df.select(*[c(k) for k in by], *[as_text(df, n).alias(n) for n in columns])
    long = text.unpivot([c(k) for k in by], [c(n) for n in columns], "feature", "value").where("value IS NOT NULL")
    if only is not None and by:
        long = long.join(join_side(only.select(*[c(k) for k in by], "feature"), "wanted"), [*by, "feature"], "left_semi")
    return long.groupBy(*[c(k) for k in by], "feature", "value").agg(F.count(F.lit(1)).alias("cnt"))


def ranked_counts(counts: DataFrame, by: list[str], order: list, label: str = "ranked") -> DataFrame:
    """Value counts with ``place`` (from 1 in ``order``) and ``size`` (values of the feature), for any number of values.

    Values are sorted over all tasks, by feature and order. A place is the number of the feature's values in earlier
    parts of the sort, plus the place within the part; so no feature is sorted or numbered in one task.
    """
    keys = [*by, "feature"]
    ordered = counts.orderBy(*[c(k) for k in keys], *order).withColumn("_at", F.monotonically_increasing_id())
    ordered = stage(ordered.withColumn("_part", F.shiftright("_at", 33)), label)
    sizes = ordered.groupBy(*[c(k) for k in keys], "_part").agg(F.count("value").alias("_n"))
    before = Window.partitionBy(*[c(k) for k in keys])
    sizes = sizes.select(
        *[c(k) for k in keys],
        "_part",
        (F.sum("_n").over(before.orderBy("_part")) - F.col("_n")).alias("_before"),
        F.sum("_n").over(before).alias("size"),
    )
    within = F.row_number().over(Window.partitionBy(*[c(k) for k in keys], "_part").orderBy("_at"))
    numbered = ordered.withColumn("_within", within).join(sizes, [*keys, "_part"])
    return numbered.withColumn("place", F.col("_before") + F.col("_within")).drop("_at", "_part", "_within", "_before")


def rarest(counts: DataFrame, by: list[str]) -> DataFrame:
    """The least frequent tenth of each feature's values, at least one, with their ``place``."""
    ranked = ranked_counts(counts, by, ["cnt", "value"])
    return ranked.where(F.col("place") <= F.greatest(F.lit(1), F.floor(F.col("size") / 10))).drop("size")


def distinct_counts(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Exact number of distinct non-null values per column; no value list is ever held in one task."""
    counts = value_counts(df, by, columns)
    return counts.groupBy(*[c(k) for k in by], "feature").agg(F.count("value").alias("unique_count"))


def categorical_stats(counts: DataFrame, by: list[str]) -> DataFrame:
    """unique_count, total, most_common, most_common_freq and entropy in bits per feature.

    Equal counts are decided for the smallest value. The entropy uses log2(total) - sum(cnt*log2(cnt))/total, which
    needs no second pass for the total.
    """
    return counts.groupBy(*[c(k) for k in by], "feature").agg(
        F.count("value").alias("unique_count"),
        F.sum("cnt").alias("total"),
        F.max("cnt").alias("most_common_freq"),
        F.min_by("value", F.struct(-F.col("cnt"), F.col("value"))).alias("most_common"),
        (F.log2(F.sum("cnt")) - F.sum(F.col("cnt") * F.log2("cnt")) / F.sum("cnt")).alias("entropy_bits"),
    )


def numeric_values(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """(key, feature, value) of numeric columns as doubles."""
    numbers = df.select(*[c(k) for k in by], *[as_number(df, n).alias(n) for n in columns])
    return numbers.unpivot([c(k) for k in by], [c(n) for n in columns], "feature", "value")


def quartiles(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    return exact_quantiles(numeric_values(df, by, columns), [*by, "feature"], QUARTILES)


def classify(summary: DataFrame) -> DataFrame:
    """Add the three roles a column can have, per key group.

    * ``as_category``: text, a boolean with gaps, or any port-like name
    * ``as_numeric``: numbers and complete booleans that vary enough, but not ports
    * ``stats_type``: numerical for number columns (ports too), categorical otherwise
    """
    port = is_port(F.col("feature"))
    gaps = F.col("non_null") < F.col("rows")
    is_text = (F.col("kind") == "text") | ((F.col("kind") == "bool") & gaps)
    return summary.withColumns(
        {
            "as_category": port | is_text,
            "as_numeric": ~port & ~is_text & F.coalesce(F.col("variance") > MIN_VARIANCE, F.lit(False)),
            "stats_type": F.when(F.col("kind") == "number", "numerical").otherwise("categorical"),
        }
    )


@dataclass
class Profile:
    """The small tables of a profile, keyed by ``by`` and feature."""

    by: list[str]
    features: DataFrame  # candidates with type, ordinal and all statistics
    counts: DataFrame  # value counts of the categorical ones

    @property
    def keys(self) -> list[str]:
        return [*self.by, "feature"]


def profile(
    df: DataFrame,
    by: list[str],
    max_cardinality: int = MAX_CARDINALITY,
    columns: list[str] | None = None,
    hold: Callable[[list[str]], DataFrame] | None = None,
) -> Profile:
    """Profile ``df`` per ``by`` and keep the candidate features with their statistics.

    Which columns the second pass has to read is brought to the driver: one row per column. ``hold`` may return a stored
    copy of ``df`` with these columns, which counts and quantiles then read instead. Value counts are stored, as both
    the statistics and the caller use them.
    """
    summary = classify(summarise(df, by, columns))
    limit = max_cardinality * APPROX_MARGIN
    plausible = F.when(F.col("as_category"), F.col("approx_distinct") <= limit).otherwise(F.col("as_numeric"))
    roles = stage(summary.where(plausible), "column-roles")
    used = roles.groupBy("feature").agg(
        F.bool_or(F.col("as_category") | (F.col("stats_type") == "categorical")).alias("counted"),
        F.bool_or(F.col("stats_type") == "numerical").alias("measured"),
    ).collect()
    position = {n: i for i, n in enumerate(df.columns)}
    counted = sorted((r.feature for r in used if r.counted), key=position.get)
    measured = sorted((r.feature for r in used if r.measured), key=position.get)

    if hold is not None:
        df = hold([n for n in df.columns if n in counted or n in measured])
    counts = stage(value_counts(df, by, counted, roles), "value-counts")
    stats = categorical_stats(counts, by)
    joined = roles.join(stats, [*by, "feature"], "left")
    if measured:
        joined = joined.join(quartiles(df, by, measured), [*by, "feature"], "left")
    else:
        joined = joined.withColumns({q: F.lit(None).cast("double") for q in QUARTILES})
    joined = joined.where(
        ~F.col("as_category") | F.coalesce(F.col("unique_count"), F.lit(0)).between(2, max_cardinality)
    )
    numerical = F.col("stats_type") == "numerical"
    features = joined.select(
        *[c(k) for k in by],
        "feature",
        "position",
        F.col("as_category").alias("is_category"),
        F.col("stats_type").alias("type"),
        "rows",
        "non_null",
        *[F.when(numerical, F.col(s)).alias(s) for s in ("mean", "std", "min", "max", "median", "q25", "q75")],
        *[F.when(~numerical, F.col(s)).alias(s) for s in ("unique_count", "total", "most_common", "most_common_freq")],
        F.when(~numerical, F.col("entropy_bits")).alias("entropy_bits"),
        F.col("mean").alias("raw_mean"),
        F.col("std_pop").alias("raw_std_pop"),
    )
    return Profile(by, features, counts)
