"""Log views over the given tables, in Spark and as SQL text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ...operators.flatten import parse_json, prepare
from .registry import table

PROPS = T.StructType([T.StructField("k", T.LongType())])
K_SQL = "CAST(json_extract(props, '$.k') AS BIGINT)"


def events(spark: SparkSession, folder: str) -> DataFrame:
    """The event log with its nested properties parsed."""
    return parse_json(table(spark, folder, "events"), "props", PROPS)


def r6(col: Column | str) -> Column:
    return F.round(F.col(col) if isinstance(col, str) else col, 6)


# ---- the profiled view: every kind of column a log can have ---------------------------------------------------------

VIEW_COLUMNS = ["user_id", "value", "dst_port", "active", "flag", "tier", "agent", "props.k", "hour", "day_of_week"]


def log_view(spark: SparkSession, folder: str, log_type: str = "event_type", time: bool = True) -> DataFrame:
    """Flat view: numbers, a port, a complete and an incomplete boolean, a category with gaps, one with many values."""
    ev = events(spark, folder)
    k = F.col("props.k")
    nested = ev.select(
        F.expr(log_type).alias("log_type"),
        "event_id",
        "user_id",
        "value",
        (1000 + F.col("event_id") % 7).alias("dst_port"),
        (F.col("user_id") % 2 == 0).alias("active"),
        F.when(k % 3 != 0, k % 2 == 0).alias("flag"),
        F.when(F.col("value") < 20, None).when(F.col("value") < 60, "mid").otherwise("high").alias("tier"),
        F.concat(F.lit("agent-"), F.col("user_id")).alias("agent"),
        "props",
        F.col("ts").alias("p_event_time"),
    )
    flat = prepare(nested).drop("p_event_time")
    return flat if time else flat.drop("hour", "day_of_week")


def view_sql(log_type: str = "event_type") -> str:
    return f"""lg AS (
  SELECT {log_type} AS log_type, event_id, user_id, value, 1000 + event_id % 7 AS dst_port, user_id % 2 = 0 AS active,
         CASE WHEN k % 3 <> 0 THEN k % 2 = 0 END AS flag,
         CASE WHEN value < 20 THEN NULL WHEN value < 60 THEN 'mid' ELSE 'high' END AS tier,
         'agent-' || user_id AS agent, k AS "props.k", hour(ts) AS hour, isodow(ts) - 1 AS day_of_week
  FROM (SELECT *, {K_SQL} AS k FROM events))"""


TEXTS = {
    "dst_port": "CAST(dst_port AS VARCHAR)",
    "active": "CASE active WHEN true THEN 'True' WHEN false THEN 'False' END",
    "flag": "CASE flag WHEN true THEN 'True' WHEN false THEN 'False' END",
    "tier": "tier",
    "agent": "agent",
}
NUMBERS = ["user_id", "value", "dst_port", "props.k", "hour", "day_of_week"]


def long_text_sql(view: str = "lg") -> str:
    parts = [f"SELECT log_type, '{f}' AS feature, {e} AS value FROM {view}" for f, e in TEXTS.items()]
    return "lt AS (SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE value IS NOT NULL)"


def long_number_sql(view: str = "lg", time: bool = True) -> str:
    names = NUMBERS if time else NUMBERS[:-2]
    parts = [f"SELECT log_type, '{f}' AS feature, CAST(\"{f}\" AS DOUBLE) AS value FROM {view}" for f in names]
    return "ln AS (" + " UNION ALL ".join(parts) + ")"


COUNTS_SQL = "vc AS (SELECT log_type, feature, value, count(*) AS cnt FROM lt GROUP BY ALL)"
CATEGORY_SQL = """cs AS (
  SELECT log_type, feature, count(*) AS unique_count, CAST(sum(cnt) AS BIGINT) AS total,
         max(cnt) AS most_common_freq, first(value ORDER BY cnt DESC, value) AS most_common,
         -sum(cnt / tot * log2(cnt / tot)) AS bits
  FROM (SELECT *, sum(cnt) OVER (PARTITION BY log_type, feature) AS tot FROM vc) GROUP BY log_type, feature)"""
NUMBER_SQL = """ns AS (
  SELECT log_type, feature, var_samp(value) AS variance, avg(value) AS mean, stddev_samp(value) AS std,
         stddev_pop(value) AS std_pop, min(value) AS lo, max(value) AS hi, quantile_cont(value, 0.5) AS median,
         quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.75) AS q75
  FROM ln GROUP BY log_type, feature)"""


def profile_sql(log_type: str = "event_type", time: bool = True) -> str:
    return ",\n".join(
        [view_sql(log_type), long_text_sql(), long_number_sql(time=time), COUNTS_SQL, CATEGORY_SQL, NUMBER_SQL]
    )


def candidates_sql(time: bool = True) -> str:
    """Candidate features with what scoring needs; follows the profile parts."""
    return """sizes AS (
  SELECT log_type, count(*) AS n, var_samp(CAST(active AS INT)) AS active_variance,
         count(flag) < count(*) AS flag_gaps FROM lg GROUP BY log_type),
cand AS (
  SELECT cs.log_type, cs.feature, CASE cs.feature WHEN 'dst_port' THEN 2 WHEN 'active' THEN 3 WHEN 'flag' THEN 4
           WHEN 'tier' THEN 5 ELSE 6 END AS position,
         cs.feature <> 'active' AND NOT (cs.feature = 'flag' AND NOT flag_gaps) AS is_category,
         CASE WHEN cs.feature = 'dst_port' THEN 'numerical' ELSE 'categorical' END AS type,
         n, unique_count, total, bits
  FROM cs JOIN sizes USING (log_type)
  WHERE CASE WHEN cs.feature = 'active' THEN active_variance > 0.01 ELSE unique_count BETWEEN 2 AND 1000 END
  UNION ALL
  SELECT ns.log_type, ns.feature, CASE ns.feature WHEN 'user_id' THEN 0 WHEN 'value' THEN 1 WHEN 'props.k' THEN 7
           WHEN 'hour' THEN 8 ELSE 9 END, false, 'numerical', n, NULL, NULL, NULL
  FROM ns JOIN sizes USING (log_type) WHERE ns.feature <> 'dst_port' AND variance > 0.01)"""


SCORED_SQL = """scored AS (
  SELECT *, 0.4 * coverage + 0.3 * CASE WHEN cardinality > 100 THEN greatest(0.1, 1 - (cardinality - 100) / 900)
                                        ELSE cardinality / 100 END
            + 0.3 * entropy + CASE WHEN feature IN ('hour', 'day_of_week') THEN 0.2 ELSE 0 END AS score
  FROM (SELECT *, row_number() OVER (PARTITION BY log_type ORDER BY is_category DESC, position) AS ordinal,
          CASE WHEN type = 'numerical' THEN 1.0 ELSE total / n END AS coverage,
          CASE WHEN type = 'numerical' THEN least(1000, n // 10) ELSE unique_count END AS cardinality,
          CASE WHEN type = 'numerical' THEN 0.7 WHEN unique_count > 1 THEN bits / log2(unique_count) ELSE bits END
            AS entropy FROM cand))"""


def selection_sql(coverages: tuple[float, ...], target: int, source: str = "scored", out: str = "sel") -> str:
    """Feature selection over the scored candidates: rows (log_type, feature, rank, forced, min_coverage)."""
    values = ", ".join(f"({x})" for x in coverages)
    return f"""{out}_t AS (SELECT s.*, t.c AS min_coverage, coverage >= t.c AND cardinality BETWEEN 2 AND 1000 AS usable
  FROM {source} s, (VALUES {values}) t(c)),
{out}_r AS (SELECT *, CASE WHEN usable THEN row_number() OVER (PARTITION BY log_type, min_coverage, usable
    ORDER BY round(score, 9) DESC, ordinal) END AS place FROM {out}_t),
{out}_c AS (SELECT *, CASE WHEN place <= {target} THEN place END AS rk FROM {out}_r),
{out}_g AS (SELECT *, count(rk) OVER g AS size,
    count(CASE WHEN rk IS NOT NULL AND type = 'numerical' THEN 1 END) OVER g AS numbers
  FROM {out}_c WINDOW g AS (PARTITION BY log_type, min_coverage)),
{out}_f AS (SELECT *, CASE WHEN rk IS NULL AND numbers = 0 AND feature IN ('hour', 'day_of_week')
    THEN row_number() OVER (PARTITION BY log_type, min_coverage, rk IS NULL AND feature IN ('hour', 'day_of_week')
      ORDER BY feature <> 'hour') END AS turn FROM {out}_g),
{out}_a AS (SELECT *, CASE WHEN turn = 1 OR size + turn - 1 < {target} THEN size + turn ELSE rk END AS r2,
    coalesce(turn = 1 OR size + turn - 1 < {target}, false) AS forced FROM {out}_f),
{out}_k AS (SELECT * FROM {out}_a WHERE r2 IS NOT NULL),
{out}_s AS (SELECT *, greatest(count(*) OVER (PARTITION BY log_type, min_coverage) - {target}, 0) AS surplus,
    row_number() OVER (PARTITION BY log_type, min_coverage, type ORDER BY r2 DESC) AS from_end FROM {out}_k),
{out}_b AS (SELECT *, max(min_coverage) OVER (PARTITION BY log_type) AS best FROM {out}_s
  WHERE type = 'numerical' OR from_end > surplus),
{out} AS (SELECT *, row_number() OVER (PARTITION BY log_type ORDER BY r2) AS rank FROM {out}_b
  WHERE min_coverage = best)"""


def fixed_sql(expression: str, digits: int) -> str:
    """Number text with a fixed number of decimals, rounded half up on its decimal form."""
    return f"CAST(CAST(round(CAST({expression} AS DECIMAL(30,10)), {digits}) AS DECIMAL(30,{digits})) AS VARCHAR)"
