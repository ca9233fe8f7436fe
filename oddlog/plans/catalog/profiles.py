"""Column profiles per log type."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import scoring
from ...functions.names import c
from ...operators import dayprofile, profile as profiles
from ...operators.select import with_ordinal, with_quality
from ...operators.profile import rarest
from ...session import new_path
from .registry import query, table
from .views import (
    CATEGORY_SQL,
    COUNTS_SQL,
    SCORED_SQL,
    VIEW_COLUMNS,
    candidates_sql,
    log_view,
    long_text_sql,
    profile_sql,
    r6,
    view_sql,
)

BY = ["log_type"]
TEXT_COLUMNS = ["dst_port", "active", "flag", "tier", "agent"]
NUMBER_COLUMNS = ["user_id", "value", "dst_port", "props.k", "hour", "day_of_week"]


@query(
    "SELECT l_returnflag AS log_type, feature, unique_count FROM (SELECT l_returnflag,"
    " count(DISTINCT l_orderkey) AS l_orderkey, count(DISTINCT l_suppkey) AS l_suppkey,"
    " count(DISTINCT l_linestatus) AS l_linestatus, count(DISTINCT l_shipdate) AS l_shipdate FROM lineitem"
    " GROUP BY l_returnflag) UNPIVOT (unique_count FOR feature IN (l_orderkey, l_suppkey, l_linestatus, l_shipdate))"
)
def distinct_counts(spark, folder):
    lines = table(spark, folder, "lineitem").withColumnRenamed("l_returnflag", "log_type")
    return profiles.distinct_counts(lines, BY, ["l_orderkey", "l_suppkey", "l_linestatus", "l_shipdate"])


@query(
    "SELECT l_returnflag AS log_type, feature, round(variance, 6) AS variance, variance > 0.01 AS varies FROM (SELECT l_returnflag,"
    " var_samp(l_quantity) AS l_quantity, var_samp(l_discount) AS l_discount, var_samp(l_tax) AS l_tax,"
    " var_samp(l_linenumber) AS l_linenumber FROM lineitem GROUP BY l_returnflag)"
    " UNPIVOT (variance FOR feature IN (l_quantity, l_discount, l_tax, l_linenumber))"
)
def sample_variance(spark, folder):
    lines = table(spark, folder, "lineitem").withColumnRenamed("l_returnflag", "log_type")
    summary = profiles.summarise(lines, BY, ["l_quantity", "l_discount", "l_tax", "l_linenumber"])
    return summary.select(
        "log_type", "feature", r6("variance").alias("variance"), (F.col("variance") > scoring.MIN_VARIANCE).alias("varies")
    )


@query(
    "SELECT l_returnflag AS log_type, f.feature, round(avg(f.v), 6) AS mean, round(stddev_samp(f.v), 6) AS std, min(f.v) AS min,"
    " max(f.v) AS max, round(quantile_cont(f.v, 0.5), 6) AS median, round(quantile_cont(f.v, 0.25), 6) AS q25,"
    " round(quantile_cont(f.v, 0.75), 6) AS q75 FROM (SELECT l_returnflag, unnest([{'feature': 'l_quantity', 'v': l_quantity},"
    " {'feature': 'l_extendedprice', 'v': l_extendedprice}, {'feature': 'l_discount', 'v': l_discount},"
    " {'feature': 'l_partkey', 'v': CAST(l_partkey AS DOUBLE)}]) AS f FROM lineitem) GROUP BY ALL"
)
def numeric_profile(spark, folder):
    lines = table(spark, folder, "lineitem").withColumnRenamed("l_returnflag", "log_type")
    names = ["l_quantity", "l_extendedprice", "l_discount", "l_partkey"]
    moments = profiles.summarise(lines, BY, names).select("log_type", "feature", "mean", "std", "min", "max")
    joined = moments.join(profiles.quartiles(lines, BY, names), ["log_type", "feature"])
    return joined.select(
        "log_type", "feature", "min", "max", *[r6(n).alias(n) for n in ("mean", "std", "median", "q25", "q75")]
    )


@query(f"WITH {view_sql()}, {long_text_sql()}, {COUNTS_SQL} SELECT log_type, feature, value, cnt FROM vc")
def value_counts(spark, folder):
    return profiles.value_counts(log_view(spark, folder), BY, TEXT_COLUMNS)


@query(
    f"WITH {view_sql()}, {long_text_sql()}, {COUNTS_SQL}, {CATEGORY_SQL}"
    " SELECT log_type, feature, unique_count, total, most_common, most_common_freq FROM cs"
)
def categorical_profile(spark, folder):
    counts = profiles.value_counts(log_view(spark, folder), BY, TEXT_COLUMNS)
    return profiles.categorical_stats(counts, BY).drop("entropy_bits")


@query(
    f"WITH {view_sql()}, {long_text_sql()}, {COUNTS_SQL}, {CATEGORY_SQL} SELECT log_type, feature,"
    " round(CASE WHEN unique_count > 1 THEN bits / log2(unique_count) ELSE bits END, 6) AS entropy FROM cs"
)
def entropy(spark, folder):
    counts = profiles.value_counts(log_view(spark, folder), BY, TEXT_COLUMNS)
    stats = profiles.categorical_stats(counts, BY)
    score = scoring.normalised_entropy(F.col("entropy_bits"), F.col("unique_count"))
    return stats.select("log_type", "feature", r6(score).alias("entropy"))


@query(
    "SELECT c_nationkey, n, round(CASE WHEN n > 100 THEN greatest(0.1, 1 - (n - 100) / 900) ELSE n / 100 END, 6) AS score"
    " FROM (SELECT c_nationkey, count(DISTINCT c_name) AS n FROM customer GROUP BY c_nationkey)"
)
def cardinality_score(spark, folder):
    customers = table(spark, folder, "customer")
    counts = profiles.distinct_counts(customers, ["c_nationkey"], ["c_name"])
    return counts.select(
        "c_nationkey", F.col("unique_count").alias("n"), r6(scoring.cardinality_score(F.col("unique_count"))).alias("score")
    )


@query(
    "WITH parts AS (SELECT log_type, count(*) AS n, count(flag) < count(*) AS flag_gaps FROM lg GROUP BY log_type)".replace(
        "WITH", f"WITH {view_sql()},"
    )
    + " SELECT log_type, f.feature, f.kind, CASE WHEN f.feature = 'dst_port' OR f.kind = 'text' THEN true"
    " WHEN f.feature = 'flag' THEN flag_gaps ELSE false END AS as_category,"
    " CASE WHEN f.kind = 'number' THEN 'numerical' ELSE 'categorical' END AS stats_type FROM (SELECT log_type, flag_gaps, unnest(["
    + ", ".join(
        f"{{'feature': '{n}', 'kind': '{k}'}}"
        for n, k in zip(
            VIEW_COLUMNS, ["number", "number", "number", "bool", "bool", "text", "text", "number", "number", "number"]
        )
    )
    + "]) AS f FROM parts)"
)
def column_types(spark, folder):
    roles = profiles.classify(profiles.summarise(log_view(spark, folder), BY, VIEW_COLUMNS))
    return roles.select("log_type", "feature", "kind", "as_category", "stats_type")


def _profile(spark, folder):
    return profiles.profile(log_view(spark, folder), BY, columns=VIEW_COLUMNS)


@query(
    f"WITH {profile_sql()}, {candidates_sql()} SELECT log_type, feature, cand.n AS rows, cand.unique_count, cand.total FROM cand"
    " WHERE is_category AND feature <> 'dst_port' UNION ALL SELECT log_type, feature, n, NULL, NULL FROM cand WHERE feature = 'dst_port'"
)
def categorical_candidates(spark, folder):
    found = _profile(spark, folder).features.where("is_category")
    return found.select("log_type", "feature", "rows", "unique_count", "total")


@query(
    f"WITH {profile_sql()}, {candidates_sql()} SELECT log_type, feature, n AS rows, type FROM cand WHERE NOT is_category"
)
def numerical_candidates(spark, folder):
    return _profile(spark, folder).features.where("NOT is_category").select("log_type", "feature", "rows", "type")


def _scored(spark, folder):
    return with_quality(with_ordinal(_profile(spark, folder).features, BY))


@query(
    f"WITH {profile_sql()}, {candidates_sql()}, {SCORED_SQL} SELECT log_type, feature, round(coverage, 6) AS coverage,"
    " CAST(cardinality AS BIGINT) AS cardinality, coverage >= 0.7 AS enough FROM scored"
)
def coverage(spark, folder):
    scored = _scored(spark, folder)
    return scored.select(
        "log_type", "feature", r6("coverage").alias("coverage"), "cardinality", (F.col("coverage") >= 0.7).alias("enough")
    )


@query(
    f"WITH {profile_sql()}, {candidates_sql()}, {SCORED_SQL} SELECT log_type, feature, round(entropy, 6) AS entropy,"
    " round(score, 6) AS score FROM scored"
)
def feature_score(spark, folder):
    return _scored(spark, folder).select("log_type", "feature", r6("entropy").alias("entropy"), r6("score").alias("score"))


MANY_SQL = (
    f"{view_sql()}, {long_text_sql()}, {COUNTS_SQL}, many AS (SELECT log_type, 'visit' AS feature,"
    " 'visit-' || event_id // 3 AS value, count(*) AS cnt FROM lg GROUP BY ALL UNION ALL SELECT * FROM vc)"
)


def _many(spark, folder):
    """Value counts of the text columns and of one with a third as many values as there are events."""
    view = log_view(spark, folder).withColumn("visit", F.concat(F.lit("visit-"), F.expr("event_id div 3")))
    return profiles.value_counts(view, BY, [*TEXT_COLUMNS, "visit"])


@query(
    f"WITH {MANY_SQL} SELECT log_type, feature, value, cnt FROM (SELECT *,"
    " row_number() OVER (PARTITION BY log_type, feature ORDER BY cnt, value) AS place,"
    " count(*) OVER (PARTITION BY log_type, feature) AS k FROM many) WHERE place <= greatest(1, k // 10)"
)
def rare_values(spark, folder):
    return rarest(_many(spark, folder), BY).select("log_type", "feature", "value", "cnt")


@query(
    f"WITH {MANY_SQL} SELECT log_type, feature, value, cnt,"
    " row_number() OVER (PARTITION BY log_type, feature ORDER BY cnt DESC, value) AS place FROM many"
)
def value_count_order(spark, folder):
    """Values of each categorical feature from the most common down."""
    ranked = profiles.ranked_counts(_many(spark, folder), BY, [F.desc("cnt"), "value"])
    return ranked.select("log_type", "feature", "value", "cnt", "place")


LAST_DAY = "2024-01-30"
SHARES = {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}
_DAYS_SQL = f"SELECT event_type AS log_type, user_id, value FROM events WHERE ts < TIMESTAMP '{LAST_DAY}' + INTERVAL 1 DAY"


def _profiled_by_day(spark, folder):
    """Events up to the last day: all earlier days are profiled first, the last one by itself, twice."""
    rows = table(spark, folder, "events").where(F.col("ts") < F.lit(f"{LAST_DAY} 23:59:59.999999").cast("timestamp_ntz"))
    rows = rows.select(F.col("event_type").alias("log_type"), "user_id", "value", F.to_date("ts").alias("day"))
    path = new_path(spark, "day-profiles")
    dayprofile.refresh(rows.where(F.col("day") < F.lit(LAST_DAY).cast("date")), path, BY, "day")
    for _ in range(2):
        dayprofile.refresh(rows, path, BY, "day", [LAST_DAY])
    return rows, dayprofile.stored(spark, path)


@query(
    f"WITH e AS ({_DAYS_SQL}) "
    + " UNION ALL ".join(
        f"SELECT log_type, '{name}' AS feature, count(*) AS rows, count({name}) AS non_null, round(avg({name}), 6) AS mean,"
        f" round(var_samp({name}), 4) AS variance, CAST(min({name}) AS DOUBLE) AS min, CAST(max({name}) AS DOUBLE) AS max,"
        " true AS distinct_near FROM e GROUP BY log_type"
        for name in ("user_id", "value")
    )
)
def day_profiles_merged(spark, folder):
    """Day profiles put together give the profile of all days; distinct counts lie within five standard errors."""
    rows, days = _profiled_by_day(spark, folder)
    exact = profiles.distinct_counts(rows.drop("day"), BY, ["user_id", "value"])
    near = F.abs(F.col("approx_distinct") - F.col("unique_count")) <= F.col("unique_count") * 0.08
    return dayprofile.merge_days(days, BY).join(exact, [*BY, "feature"]).select(
        *BY, "feature", "rows", "non_null", r6("mean").alias("mean"), F.round("variance", 4).alias("variance"), "min", "max",
        near.alias("distinct_near"),
    )


@query(
    f"WITH e AS ({_DAYS_SQL}) SELECT log_type, feature, share, count(*) AS n, true AS within"
    " FROM (SELECT log_type, 'user_id' AS feature FROM e WHERE user_id IS NOT NULL"
    " UNION ALL SELECT log_type, 'value' FROM e WHERE value IS NOT NULL),"
    f" (VALUES {', '.join(f'({share}::DOUBLE)' for share in SHARES.values())}) AS s(share) GROUP BY ALL"
)
def day_profile_ranks(spark, folder):
    """Quantiles of the merged sketches: their true ranks, counted over all rows, lie within the stated error."""
    rows, days = _profiled_by_day(spark, folder)
    wide = dayprofile.merge_days(days, BY, SHARES)
    asked = F.array(*[F.struct(F.lit(share).alias("share"), F.col(name).alias("cut")) for name, share in SHARES.items()])
    values = profiles.numeric_values(rows.drop("day"), BY, ["user_id", "value"]).where("value IS NOT NULL")
    counted = values.groupBy(*BY, "feature", "value").agg(F.count(F.lit(1)).alias("n"))
    ranks = (
        counted.join(wide.select(*BY, "feature", F.inline(asked)), [*BY, "feature"])
        .groupBy(*BY, "feature", "share")
        .agg(
            F.sum("n").alias("n"),
            F.coalesce(F.sum(F.when(F.col("value") < F.col("cut"), F.col("n"))), F.lit(0)).alias("below"),
            F.coalesce(F.sum(F.when(F.col("value") <= F.col("cut"), F.col("n"))), F.lit(0)).alias("upto"),
        )
    )
    low, high = F.col("below") / F.col("n") - dayprofile.RANK_ERROR, F.col("upto") / F.col("n") + dayprofile.RANK_ERROR
    return ranks.select(*BY, "feature", "share", "n", F.col("share").between(low, high).alias("within"))
