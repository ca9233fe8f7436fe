"""Column expressions behind feature quality, deviations and explanations."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from .text import fixed

# Thresholds and texts of the published behaviour.
DEFAULT_THRESHOLD = -0.2
NUMERIC_ENTROPY = 0.7
COVERAGE_WEIGHT, CARDINALITY_WEIGHT, ENTROPY_WEIGHT, TEMPORAL_BONUS = 0.4, 0.3, 0.3, 0.2
MAX_CARDINALITY = 1000
MIN_VARIANCE = 0.01
EULER = 0.5772156649
NO_DEVIATIONS = "No feature deviations calculated for analysis."


def z_score(value: Column, mean: Column, std: Column) -> Column:
    """Distance from the mean in standard deviations; a constant baseline gives 0."""
    return F.when(std > 0, (value - mean) / std).otherwise(F.lit(0.0))


def rarity(count: Column, total: Column) -> Column:
    """1 - share of the value in training; unseen values and empty baselines give 1."""
    return F.when(total > 0, 1 - F.coalesce(count, F.lit(0)) / total).otherwise(F.lit(1.0))


def deviation_level(z: Column) -> Column:
    size = F.abs(z)
    return F.when(size > 3, "extreme").when(size > 2, "high").when(size > 1, "moderate").otherwise("normal")


def rarity_level(score: Column) -> Column:
    return (
        F.when(score > 0.95, "extremely_rare")
        .when(score > 0.8, "rare")
        .when(score > 0.5, "uncommon")
        .otherwise("common")
    )


def normalised_entropy(bits: Column, distinct: Column) -> Column:
    """Entropy divided by its maximum for that many values."""
    return F.when(distinct > 1, bits / F.log2(distinct)).when(distinct == 1, bits).otherwise(F.lit(0.0))


def cardinality_score(distinct: Column) -> Column:
    """Rises to 1 at 100 distinct values, then falls linearly to 0.1 at 910 and stays there."""
    return F.when(distinct > 100, F.greatest(F.lit(0.1), 1 - (distinct - 100) / 900)).otherwise(distinct / 100)


def numeric_cardinality(rows: Column) -> Column:
    """Cardinality assumed for a numerical feature: a tenth of the rows, at most 1000."""
    return F.least(F.lit(MAX_CARDINALITY).cast("bigint"), F.floor(rows / 10).cast("bigint"))


def quality(coverage: Column, distinct: Column, entropy: Column, temporal: Column) -> Column:
    """Feature quality score: weighted coverage, cardinality and entropy, plus a bonus for hour and day of week."""
    return (
        coverage * COVERAGE_WEIGHT
        + cardinality_score(distinct) * CARDINALITY_WEIGHT
        + entropy * ENTROPY_WEIGHT
        + F.when(temporal, TEMPORAL_BONUS).otherwise(0.0)
    )


def average_path(size: int) -> float:
    """Expected path length of an unsuccessful search in a tree of ``size`` points (Liu et al. 2008)."""
    if size <= 1:
        return 0.0
    if size == 2:
        return 1.0
    return 2.0 * (math.log(size - 1.0) + EULER) - 2.0 * (size - 1.0) / size


def notable_text(deviations: Column, is_anomaly: Column) -> Column:
    """The notable features of an ordered deviation array as text: the first three for an anomaly, two otherwise."""
    levels = F.array(*[F.lit(x) for x in ("high", "extreme", "rare", "extremely_rare")])
    notable = F.filter(deviations, lambda d: F.array_contains(levels, d["deviation_level"]))
    named = F.transform(
        F.slice(notable, 1, F.when(is_anomaly, 3).otherwise(2)),
        lambda d: F.when(
            d["type"] == "numerical", F.concat(d["feature"], F.lit(" (z-score: "), fixed(d["z_score"], 1), F.lit(")"))
        ).otherwise(F.concat(d["feature"], F.lit(" (rarity: "), fixed(d["rarity_score"], 2), F.lit(")"))),
    )
    return F.array_join(named, ", ")


def explanation(deviations: Column, notable: Column, score: Column, is_anomaly: Column) -> Column:
    """One sentence per event from its deviations and the text of the notable ones."""
    head = F.concat(
        F.lit("This event appears "),
        F.when(is_anomaly, "anomalous").otherwise("normal"),
        F.lit(" (score: "),
        fixed(score, 3),
        F.lit(")"),
    )
    tail = (
        F.when(is_anomaly & (notable != ""), F.concat(F.lit(" due to unusual patterns in "), notable, F.lit(".")))
        .when(is_anomaly, F.lit(" due to unusual feature combinations."))
        .when(notable != "", F.concat(F.lit(" despite some variations in "), notable, F.lit(".")))
        .otherwise(F.lit(" with typical feature patterns."))
    )
    return F.when(F.size(deviations) == 0, F.lit(NO_DEVIATIONS)).otherwise(F.concat(head, tail))
