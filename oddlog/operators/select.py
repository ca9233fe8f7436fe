"""Feature selection on the small profile table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.names import EXCLUDED_FEATURE, HOUR_DUPLICATE, TEMPORAL_FEATURES, c
from ..functions.scoring import MAX_CARDINALITY, NUMERIC_ENTROPY, normalised_entropy, numeric_cardinality, quality

TARGET = 10  # fixed values
TRAINING_COVERAGES = (0.6, 0.5, 0.3, 0.1)
DETECTION_COVERAGE = 0.7
SCORE_DIGITS = 9


def with_ordinal(features: DataFrame, by: list[str]) -> DataFrame:
    """Order of candidates before scoring: categories first, then numbers, each in column order."""
    window = Window.partitionBy(*[c(k) for k in by]).orderBy(F.desc("is_category"), "position")
    return features.withColumn("ordinal", F.row_number().over(window) - 1)


def with_quality(features: DataFrame) -> DataFrame:
    """Add coverage, cardinality, normalised entropy and the quality score.

    Numerical features count as always present, with an assumed cardinality and entropy.
    """
    numerical = F.col("type") == "numerical"
    scored = features.withColumns(
        {
            "coverage": F.when(numerical, F.lit(1.0)).otherwise(F.coalesce(F.col("total"), F.lit(0)) / F.col("rows")),
            "cardinality": F.when(numerical, numeric_cardinality(F.col("rows"))).otherwise(F.col("unique_count")),
            "entropy": F.when(numerical, F.lit(NUMERIC_ENTROPY)).otherwise(
                F.coalesce(normalised_entropy(F.col("entropy_bits"), F.col("unique_count")), F.lit(0.0))
            ),
        }
    )
    temporal = F.col("feature").isin(*TEMPORAL_FEATURES)
    score = quality(F.col("coverage"), F.col("cardinality"), F.col("entropy"), temporal)
    # sums of floats depend on the order of partial sums; rounded, equal features tie and column order decides
    return scored.withColumn("score", F.round(score, SCORE_DIGITS))


def rank_features(scored: DataFrame, group: list[str], coverage: Column, target: int = TARGET) -> DataFrame:
    """Add ``rank`` (null for features not chosen) and ``forced``; all steps are windows over the same small groups.

    The best ``target`` usable features are ranked by score. Business-hours flags never count, nor does the duplicate
    hour once ``hour`` ranks above it. Where no numerical feature was chosen, ``hour`` and then ``day_of_week`` are
    appended until the target is reached, whatever their coverage; should that exceed the target by one, the lowest
    ranked categories make room.
    """
    keys = [c(k) for k in group]
    every = Window.partitionBy(*keys)
    order = F.struct(-F.col("score"), F.col("ordinal"))

    ranked = scored.withColumn(
        "usable",
        (F.col("coverage") >= coverage)
        & F.col("cardinality").between(2, MAX_CARDINALITY)
        & (F.col("feature") != EXCLUDED_FEATURE),
    )
    best_hour = F.min(F.when(F.col("usable") & (F.col("feature") == "hour"), order)).over(every)
    ranked = ranked.withColumn("hour_order", best_hour).withColumn(
        "usable",
        F.col("usable") & ~((F.col("feature") == HOUR_DUPLICATE) & F.coalesce(F.col("hour_order") < order, F.lit(False))),
    )
    place = F.row_number().over(Window.partitionBy(*keys, "usable").orderBy(F.desc("score"), "ordinal"))
    ranked = ranked.withColumn("rank", F.when(F.col("usable"), place)).withColumn(
        "rank", F.when(F.col("rank") <= target, F.col("rank"))
    )

    chosen, number = F.col("rank").isNotNull(), F.col("type") == "numerical"
    ranked = ranked.withColumns(
        {
            "size": F.count("rank").over(every),
            "forceable": ~chosen
            & F.col("feature").isin(*TEMPORAL_FEATURES)
            & (F.max(F.when(chosen & number, 1).otherwise(0)).over(every) == 0),
        }
    )
    turn = F.row_number().over(
        Window.partitionBy(*keys, "forceable").orderBy(F.col("feature") != TEMPORAL_FEATURES[0], "ordinal")
    )
    ranked = ranked.withColumn("turn", turn).withColumn(
        "forced", F.col("forceable") & ((F.col("turn") == 1) | (F.col("size") + F.col("turn") - 1 < target))
    )
    ranked = ranked.withColumn("rank", F.when(F.col("forced"), F.col("size") + F.col("turn")).otherwise(F.col("rank")))

    surplus = F.greatest(F.count("rank").over(every) - target, F.lit(0))
    from_end = F.row_number().over(Window.partitionBy(*keys, "type").orderBy(F.desc_nulls_last("rank")))
    ranked = ranked.withColumns({"surplus": surplus, "from_end": from_end}).withColumn(
        "rank",
        F.when((F.col("type") == "categorical") & (F.col("from_end") <= F.col("surplus")), None).otherwise(F.col("rank")),
    )
    dense = F.row_number().over(Window.partitionBy(*keys).orderBy(F.asc_nulls_last("rank")))
    return ranked.withColumn("rank", F.when(F.col("rank").isNotNull(), dense)).drop(
        "usable", "hour_order", "size", "forceable", "turn", "surplus", "from_end"
    )


def cascade(scored: DataFrame, by: list[str], coverages=TRAINING_COVERAGES, target: int = TARGET) -> DataFrame:
    """Try coverage thresholds from strict to loose; per group the first one that yields a feature wins."""
    tries = scored.withColumn("min_coverage", F.explode(F.array(*[F.lit(x) for x in coverages])))
    chosen = rank_features(tries, [*by, "min_coverage"], F.col("min_coverage"), target).where("rank IS NOT NULL")
    best = F.max("min_coverage").over(Window.partitionBy(*[c(k) for k in by]))
    return chosen.withColumn("best", best).where("min_coverage = best").drop("best")


def select_features(features: DataFrame, by: list[str], target: int = TARGET, coverages=TRAINING_COVERAGES) -> DataFrame:
    """Training selection: profile rows of the chosen features with their ``slot`` in the model.

    Slots follow the model's column order: categories by rank, then numbers by rank.
    """
    scored = with_quality(with_ordinal(features, by))
    chosen = cascade(scored, by, coverages, target)
    slots = Window.partitionBy(*[c(k) for k in by]).orderBy(F.desc("is_category"), "rank")
    return chosen.withColumn("slot", F.row_number().over(slots) - 1)


def mark_optimal(selected: DataFrame, by: list[str], target: int = TARGET) -> DataFrame:
    """Selection as used at detection (stricter coverage, over the trained model's own features), computed once."""
    scored = selected.withColumnsRenamed({"rank": "training_rank", "forced": "training_forced"})
    scored = scored.withColumn("ordinal", F.col("slot"))
    marked = rank_features(scored, by, F.lit(DETECTION_COVERAGE), target).drop("forced")
    return marked.withColumnsRenamed(
        {"rank": "optimal_rank", "training_rank": "rank", "training_forced": "forced"}
    ).withColumn("is_optimal", F.col("optimal_rank").isNotNull())


def feature_lists(selected: DataFrame, by: list[str]) -> DataFrame:
    """Chosen names per log type split into categorical and numerical lists, best first."""

    def names(where):
        entries = F.sort_array(F.collect_list(F.when(where, F.struct("rank", "feature"))))
        return F.transform(entries, lambda e: e["feature"])

    return selected.groupBy(*[c(k) for k in by]).agg(
        names(F.col("is_category")).alias("categorical_features"),
        names(~F.col("is_category")).alias("numerical_features"),
    )
