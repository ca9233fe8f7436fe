"""Feature selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import profile as profiles, select
from .registry import query
from .views import SCORED_SQL, VIEW_COLUMNS, candidates_sql, log_view, profile_sql, r6, selection_sql

BY = ["log_type"]
# about 13 rows each: too few for numbers to count as varied, so categories compete and temporal features are forced
SMALL_GROUPS = "concat(event_type, '/', user_id)"
SMALL_GROUPS_SQL = "event_type || '/' || user_id"


def _features(spark, folder, log_type: str = "event_type", time: bool = True):
    columns = VIEW_COLUMNS if time else VIEW_COLUMNS[:-2]
    return profiles.profile(log_view(spark, folder, log_type, time), BY, columns=columns).features


@query(
    f"WITH {profile_sql()}, {candidates_sql()}, {SCORED_SQL}, {selection_sql((0.6,), 5)}"
    " SELECT log_type, feature, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM sel"
)
def top_features(spark, folder):
    chosen = select.select_features(_features(spark, folder), BY, 5, (0.6,))
    return chosen.select("log_type", "feature", "rank", r6("score").alias("score"))


@query(
    f"WITH {profile_sql(SMALL_GROUPS_SQL)}, {candidates_sql()}, {SCORED_SQL}, {selection_sql((0.6, 0.5, 0.3, 0.1), 2)}"
    " SELECT log_type, feature, CAST(rank AS INTEGER) AS rank, forced FROM sel"
)
def forced_temporal(spark, folder):
    chosen = select.select_features(_features(spark, folder, SMALL_GROUPS), BY, 2)
    return chosen.select("log_type", "feature", "rank", "forced")


@query(
    f"WITH {profile_sql(SMALL_GROUPS_SQL, time=False)}, {candidates_sql()}, {SCORED_SQL},"
    f" {selection_sql((0.9, 0.6, 0.5, 0.3, 0.1), 10)}"
    " SELECT log_type, feature, CAST(rank AS INTEGER) AS rank, CAST(min_coverage AS DOUBLE) AS min_coverage FROM sel"
)
def coverage_cascade(spark, folder):
    features = _features(spark, folder, SMALL_GROUPS, time=False)
    chosen = select.select_features(features, BY, coverages=(0.9, 0.6, 0.5, 0.3, 0.1))
    return chosen.select("log_type", "feature", "rank", "min_coverage")


@query(
    f"WITH {profile_sql()}, {candidates_sql()},"
    " renamed AS (SELECT * REPLACE (CASE feature WHEN 'value' THEN 'hour_of_day' WHEN 'agent' THEN 'is_business_hours'"
    " ELSE feature END AS feature) FROM cand), "
    + SCORED_SQL.replace("FROM cand", "FROM renamed")
    + " SELECT log_type, feature FROM scored WHERE feature NOT IN ('hour_of_day', 'is_business_hours')"
)
def redundant_features(spark, folder):
    """Names that repeat the hour are dropped, whatever their score."""
    features = _features(spark, folder)
    name = F.col("feature")
    renamed = features.withColumn(
        "feature", F.when(name == "value", "hour_of_day").when(name == "agent", "is_business_hours").otherwise(name)
    )
    ranked = select.rank_features(select.with_quality(select.with_ordinal(renamed, BY)), BY, F.lit(0.0), 100)
    return ranked.where("rank IS NOT NULL").select("log_type", "feature")


@query(
    f"WITH {profile_sql()}, {candidates_sql()}, {SCORED_SQL}, {selection_sql((0.6, 0.5, 0.3, 0.1), 10)}"
    " SELECT log_type, string_agg(CASE WHEN is_category THEN feature END, ',' ORDER BY rank) AS categorical,"
    " string_agg(CASE WHEN NOT is_category THEN feature END, ',' ORDER BY rank) AS numerical FROM sel GROUP BY log_type"
)
def feature_list_split(spark, folder):
    lists = select.feature_lists(select.select_features(_features(spark, folder), BY), BY)
    return lists.select(
        "log_type",
        F.array_join("categorical_features", ",").alias("categorical"),
        F.array_join("numerical_features", ",").alias("numerical"),
    )


OPTIMAL_SQL = (
    f"{profile_sql()}, {candidates_sql()}, {SCORED_SQL}, {selection_sql((0.6, 0.5, 0.3, 0.1), 10)},"
    " slots AS (SELECT * EXCLUDE (ordinal, min_coverage, usable, rank, forced, size, place, rk, numbers, turn, r2, surplus,"
    " from_end, best), row_number() OVER (PARTITION BY log_type ORDER BY is_category DESC, rank) - 1 AS ordinal FROM sel), "
    + selection_sql((0.7,), 6, "slots", "opt")
)


@query(
    f"WITH {OPTIMAL_SQL} SELECT s.log_type, s.feature, CAST(s.ordinal AS INTEGER) AS slot, o.rank IS NOT NULL AS is_optimal,"
    " CAST(o.rank AS INTEGER) AS optimal_rank FROM slots s LEFT JOIN opt o ON s.log_type = o.log_type AND s.feature = o.feature"
)
def detection_features(spark, folder):
    """Slots of the trained model and which of them detection uses (target 6, coverage 0.7)."""
    selected = select.select_features(_features(spark, folder), BY)
    marked = select.mark_optimal(selected, BY, 6)
    return marked.select("log_type", "feature", "slot", "is_optimal", "optimal_rank")
