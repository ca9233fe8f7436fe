"""Routing, scoring and explaining events against a model with a small fixed forest, so SQL can follow every step."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ...operators import encode, forest as trees, reports
from ...operators.detect import Scorer, alerts, detect, score_requests
from ...operators.flatten import flatten, prepare
from ...operators.prepared import Prepared
from ...operators.profile import Profile, profile
from ...operators.requests import read_requests
from ...operators.route import route
from ...operators.synth import synthesise
from ...session import stage
from ...sources.models import Model
from .. import train
from .registry import query, remembered, table
from .views import K_SQL, events, fixed_sql, r6

BY = ["log_type"]
OFFSET, LIMIT = -0.7, -0.02
COLUMNS = ["user_id", "value", "tier", "agent", "props.k", "hour", "day_of_week"]
# nodes name features; their slots follow from the selection of each log type
FIXED_FOREST = [
    (0, 1, "value", 1.0, None), (0, 2, None, None, 6.0), (0, 3, "hour", 0.5, None), (0, 6, None, None, 2.5),
    (0, 7, None, None, 3.5),
    (1, 1, "tier", 0.5, None), (1, 2, None, None, 4.0), (1, 3, None, None, 5.5),
    (2, 1, "props.k", -1.0, None), (2, 2, None, None, 3.0), (2, 3, "user_id", 0.2, None), (2, 6, None, None, 7.25),
    (2, 7, None, None, 4.75),
]
SOURCES = {"click": "IAM.amazonaws.com", "view": "config.amazonaws.com", "purchase": "vpc-flow-logs.amazonaws.com"}


def security_events(spark: SparkSession, folder: str) -> DataFrame:
    """Nested events of five sources, two of which no model covers."""
    u, kind = F.col("user_id") % 150, F.col("event_type")
    source = F.lit("signin.amazonaws.com")
    for name, text in SOURCES.items():
        source = F.when(kind == name, text).otherwise(source)
    return events(spark, folder).select(
        "event_id",
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("p_event_time"),
        F.when(kind != "error", source).alias("eventsource"),
        F.when(kind == "error", "high").alias("severity"),
        "user_id",
        "value",
        F.when(F.col("value") < 21, None).when(F.col("value") < 60, "mid").otherwise("high").alias("tier"),
        F.when(u < 90, "agent-a").when(u < 135, "agent-b").when(u < 149, "agent-c").otherwise("agent-d").alias("agent"),
        "props",
    )


MODELS = ["AWS Config", "AWS IAM", "AWS VPC Flow"]
EVENTS_SQL = f"""d AS (
  SELECT event_id, CASE event_type WHEN 'click' THEN 'AWS IAM' WHEN 'view' THEN 'AWS Config' WHEN 'purchase' THEN
           'AWS VPC Flow' END AS log_type,
         event_type, user_id, value, {K_SQL} AS k, hour(ts) AS hour, isodow(ts) - 1 AS dow,
         CASE WHEN value < 21 THEN NULL WHEN value < 60 THEN 'mid' ELSE 'high' END AS tier,
         CASE WHEN user_id % 150 < 90 THEN 'agent-a' WHEN user_id % 150 < 135 THEN 'agent-b' WHEN user_id % 150 < 149
           THEN 'agent-c' ELSE 'agent-d' END AS agent FROM events),
st AS (
  SELECT log_type, count(*) AS n, count(tier) AS n_tier, count(DISTINCT agent) AS agents, {", ".join(
      f"avg({x}) AS m_{x}, stddev_samp({x}) AS s_{x}, stddev_pop({x}) AS p_{x}"
      for x in ("hour", "dow", "user_id", "value", "k")
  )} FROM d WHERE log_type IS NOT NULL GROUP BY log_type),
ac AS (SELECT log_type, agent, count(*) AS cnt FROM d GROUP BY ALL),
tn AS (SELECT log_type, tier, count(*) AS tier_cnt FROM d WHERE tier IS NOT NULL GROUP BY ALL),
tc AS (SELECT log_type, tier, row_number() OVER (PARTITION BY log_type ORDER BY tier) - 1 AS code
  FROM (SELECT DISTINCT log_type, coalesce(tier, 'unknown') AS tier FROM d)),
x AS (
  SELECT d.*, st.n, ac.cnt, tc.code AS x1, {", ".join(
      f"({v} - m_{v}) / s_{v} AS z_{v}, ({v} - m_{v}) / p_{v} AS x_{v}" for v in ("hour", "dow", "user_id", "value", "k")
  )}, CASE WHEN agents > 1 THEN 1 - ac.cnt / st.n END AS rare, agents,
    CASE WHEN n_tier >= 0.7 * n THEN tier_cnt END AS tier_cnt, n_tier
  FROM d LEFT JOIN st USING (log_type) LEFT JOIN ac ON ac.log_type = d.log_type AND ac.agent = d.agent
  LEFT JOIN tn ON tn.log_type = d.log_type AND tn.tier = d.tier
  LEFT JOIN tc ON tc.log_type = d.log_type AND tc.tier = coalesce(d.tier, 'unknown')),
p AS (
  SELECT *, (CASE WHEN x_value <= 1.0 THEN 6.0 WHEN x_hour <= 0.5 THEN 2.5 ELSE 3.5 END
           + CASE WHEN x1 <= 0.5 THEN 4.0 ELSE 5.5 END
           + CASE WHEN x_k <= -1.0 THEN 3.0 WHEN x_user_id <= 0.2 THEN 7.25 ELSE 4.75 END) / 3.0 AS path,
         least(256, n) AS psi FROM x),
s AS (
  SELECT *, CASE WHEN n IS NOT NULL THEN
    -pow(2.0, -path / (2 * (ln(psi - 1) + 0.5772156649) - 2.0 * (psi - 1) / psi)) END AS score FROM p),
notable AS (
  SELECT *, score - ({OFFSET}) AS decision,
    list_filter([CASE WHEN rare > 0.8 THEN 'agent (rarity: ' || {fixed_sql('rare', 2)} || ')' END,
      CASE WHEN 1 - tier_cnt / n_tier > 0.8 THEN 'tier (rarity: ' || {fixed_sql('1 - tier_cnt / n_tier', 2)} || ')' END, {", ".join(
      f"CASE WHEN abs(z_{v}) > 2 THEN '{f} (z-score: ' || {fixed_sql(f'z_{v}', 1)} || ')' END"
      for v, f in (("hour", "hour"), ("dow", "day_of_week"), ("user_id", "user_id"), ("value", "value"), ("k", "props.k"))
  )}], lambda e: e IS NOT NULL) AS notable FROM s),
r AS (SELECT *, decision < {LIMIT} AS is_anomaly, CASE WHEN n IS NULL THEN
    'No model available for log type: None' END AS error FROM notable),
res AS (
  SELECT *, CASE WHEN error IS NOT NULL THEN NULL
    WHEN is_anomaly AND len(notable) > 0 THEN 'This event appears anomalous (score: ' || {fixed_sql('decision', 3)}
      || ') due to unusual patterns in ' || array_to_string(notable[1:3], ', ') || '.'
    WHEN is_anomaly THEN 'This event appears anomalous (score: ' || {fixed_sql('decision', 3)}
      || ') due to unusual feature combinations.'
    WHEN len(notable) > 0 THEN 'This event appears normal (score: ' || {fixed_sql('decision', 3)}
      || ') despite some variations in ' || array_to_string(notable[1:2], ', ') || '.'
    ELSE 'This event appears normal (score: ' || {fixed_sql('decision', 3)} || ') with typical feature patterns.'
    END AS explanation FROM r)"""


@remembered("events")
def fixed_model(spark: SparkSession, folder: str) -> Model:
    """Statistics, selection and encoders learnt from the events; the forest is given."""
    raw = security_events(spark, folder)
    routed = flatten(raw).withColumn("log_type", route(flatten(raw), MODELS)).where("log_type IS NOT NULL")
    found = profile(prepare(routed), BY, columns=COLUMNS)
    found = Profile(BY, stage(found.features, "profile"), found.counts)
    features = stage(train.model_features(found), "features")
    values = stage(encode.fit_values(features, found.counts, BY), "values")
    sizes = features.groupBy("log_type").agg(F.max("rows").alias("training_samples"))
    models = sizes.withColumns(
        {"psi": F.least(F.lit(256), F.col("training_samples")).cast("int"), "offset": F.lit(OFFSET)}
    )
    nodes = spark.createDataFrame(
        [(log_type, *node) for log_type in MODELS for node in FIXED_FOREST],
        "log_type string, tree int, node int, feature string, threshold double, path_length double",
    )
    slots = features.select("log_type", "feature", F.col("slot").cast("int").alias("slot"))
    forest = nodes.join(slots, ["log_type", "feature"], "left").select(
        "log_type", "tree", "node", F.col("slot").alias("feature"), "threshold", "path_length"
    )
    return Model(stage(models, "models"), features, values, forest)


@remembered("events")
def fixed_scorer(spark: SparkSession, folder: str) -> Scorer:
    return Scorer(fixed_model(spark, folder))


def _detected(spark, folder) -> DataFrame:
    return detect(security_events(spark, folder), fixed_scorer(spark, folder), LIMIT, keep=("event_id",))


def _deviations(spark, folder) -> DataFrame:
    """One row per event and feature. Plain ``inline`` would first filter by the array, which builds it a second time."""
    rows = _detected(spark, folder).select("event_id", F.inline_outer("feature_deviations"))
    return rows.where("feature IS NOT NULL")


@query(
    "SELECT event_id, CASE event_type WHEN 'click' THEN 'AWS IAM' WHEN 'view' THEN 'AWS Config' WHEN 'purchase' THEN"
    " 'AWS VPC Flow' WHEN 'error' THEN 'alert_logs' END AS log_type FROM events"
)
def route_log_type(spark, folder):
    flat = flatten(security_events(spark, folder))
    return flat.select("event_id", route(flat, [*MODELS, "alert_logs"]).alias("log_type"))


@query(
    "SELECT event_id, CASE WHEN user_id % 3 = 0 THEN 'audit_logs' WHEN event_type = 'error' THEN 'alert_logs' WHEN event_type"
    " = 'click' THEN 'AWS IAM' WHEN value > 60 THEN 'audit_logs' END AS log_type FROM events"
)
def route_explicit(spark, folder):
    """A given log type wins over the source; then alert-like, then audit-like fields."""
    flat = flatten(security_events(spark, folder)).withColumns(
        {
            "stated": F.when(F.col("user_id") % 3 == 0, "audit_logs"),
            "actor": F.when(F.col("tier") == "high", F.col("agent")).when(F.col("value") == 60, None),
        }
    )
    flat = flat.withColumn("actor", F.when(F.col("value") > 60, F.col("agent")))
    return flat.select("event_id", route(flat, ["AWS IAM", "alert_logs", "audit_logs"], "stated").alias("log_type"))


DETECTED_SQL = (
    f"WITH {EVENTS_SQL} SELECT event_id, log_type, is_anomaly, round(decision, 6) AS anomaly_score,"
    f" CASE WHEN n IS NOT NULL THEN {LIMIT}::DOUBLE END AS anomaly_threshold, explanation,"
    " n AS training_samples, CAST(CASE WHEN n IS NOT NULL THEN 5 + (agents > 1)::INT + (tier_cnt IS NOT NULL)::INT END AS INTEGER) AS features_found, error FROM res"
)


@query(DETECTED_SQL)
def detect_batch(spark, folder):
    return _facts(_detected(spark, folder))


@remembered("events")
def prepared_model(spark: SparkSession, folder: str) -> Prepared:
    return Prepared(fixed_model(spark, folder))


@query(DETECTED_SQL)
def detect_prepared(spark, folder):
    """The same events through the model that answers single ones: no join and no Python worker in the plan."""
    return _facts(detect(security_events(spark, folder), prepared_model(spark, folder), LIMIT, keep=("event_id",)))


@query(
    f"WITH {EVENTS_SQL} SELECT event_id, list_sort(list_filter([CASE WHEN agents > 1 THEN 'agent' END,"
    " CASE WHEN tier_cnt IS NOT NULL THEN 'tier' END, 'hour', 'day_of_week', 'user_id', 'value', 'props.k'],"
    " lambda f: f IS NOT NULL)) AS features, round(list_sum(list_transform([z_hour, z_dow, z_user_id, z_value, z_k],"
    " lambda z: abs(z))), 4) AS distance FROM res WHERE n IS NOT NULL"
)
def prepared_deviations(spark, folder):
    """Deviations of the prepared model: which features, and how far the numbers lie from their means in all."""
    found = detect(security_events(spark, folder), prepared_model(spark, folder), LIMIT, keep=("event_id",))
    each = F.col("feature_deviations")
    far = F.aggregate(each, F.lit(0.0), lambda total, d: total + F.coalesce(F.abs(d["z_score"]), F.lit(0.0)))
    features = F.sort_array(F.transform(each, lambda d: d["feature"]))
    return found.where("error IS NULL").select("event_id", features.alias("features"), F.round(far, 4).alias("distance"))


def _facts(found: DataFrame) -> DataFrame:
    info = F.col("model_info")
    return found.select(
        "event_id",
        "log_type",
        "is_anomaly",
        r6("anomaly_score").alias("anomaly_score"),
        "anomaly_threshold",
        "explanation",
        info["training_samples"].alias("training_samples"),
        info["features_found_in_event"].alias("features_found"),
        "error",
    )


@query(f"WITH {EVENTS_SQL} SELECT event_id, round(score, 6) AS score FROM s WHERE n IS NOT NULL")
def forest_score_fixed(spark, folder):
    scorer = fixed_scorer(spark, folder)
    raw = flatten(security_events(spark, folder))
    ready = prepare(raw.withColumn("log_type", route(raw, MODELS)))
    return scorer.score(scorer.encode(ready, ["event_id"], how="inner")).select("event_id", r6("score").alias("score"))


def _scores(spark, folder) -> DataFrame:
    scorer = fixed_scorer(spark, folder)
    raw = flatten(security_events(spark, folder))
    ready = prepare(raw.withColumn("log_type", route(raw, MODELS)))
    return stage(scorer.score(scorer.encode(ready, [], how="inner")).select("log_type", r6("score").alias("score")), "scores")


OFFSETS_SQL = (
    "sr AS (SELECT log_type, round(score, 6) AS score FROM s WHERE n IS NOT NULL),"
    " off AS (SELECT log_type, quantile_cont(score, 0.1) AS o FROM sr GROUP BY log_type)"
)


@query(f"WITH {EVENTS_SQL}, {OFFSETS_SQL} SELECT log_type, round(o, 6) AS \"offset\" FROM off")
def score_offset(spark, folder):
    return trees.score_offsets(_scores(spark, folder)).withColumn("offset", r6("offset"))


@query(
    f"WITH {EVENTS_SQL}, {OFFSETS_SQL} SELECT log_type, round(avg(CASE WHEN score - o < 0 THEN 1.0 ELSE 0 END), 6)"
    " AS anomaly_rate FROM sr JOIN off USING (log_type) GROUP BY log_type"
)
def anomaly_rate(spark, folder):
    scores = _scores(spark, folder)
    return trees.anomaly_rates(scores, trees.score_offsets(scores)).withColumn("anomaly_rate", r6("anomaly_rate"))


@query(
    f"WITH {EVENTS_SQL} SELECT event_id, feature, type, round(z, 6) AS z_score, cnt AS frequency,"
    " CASE WHEN type = 'categorical' THEN n END AS total_samples, round(CASE WHEN type = 'categorical' THEN rare END, 6)"
    " AS rarity_score, CASE WHEN type = 'categorical' THEN CASE WHEN rare > 0.95 THEN 'extremely_rare' WHEN rare > 0.8 THEN"
    " 'rare' WHEN rare > 0.5 THEN 'uncommon' ELSE 'common' END WHEN abs(z) > 3 THEN 'extreme' WHEN abs(z) > 2 THEN 'high'"
    " WHEN abs(z) > 1 THEN 'moderate' ELSE 'normal' END AS deviation_level FROM ("
    " SELECT event_id, 'agent' AS feature, 'categorical' AS type, NULL AS z, cnt, n, rare FROM res WHERE agents > 1"
    " UNION ALL SELECT event_id, 'tier', 'categorical', NULL, tier_cnt, n_tier, 1 - tier_cnt / n_tier FROM res"
    " WHERE tier_cnt IS NOT NULL"
    + "".join(
        f" UNION ALL SELECT event_id, '{f}', 'numerical', z_{v}, NULL, n, rare FROM res WHERE n IS NOT NULL"
        for v, f in (("hour", "hour"), ("dow", "day_of_week"), ("user_id", "user_id"), ("value", "value"), ("k", "props.k"))
    )
    + ")"
)
def feature_deviations(spark, folder):
    rows = _deviations(spark, folder)
    return rows.select(
        "event_id",
        "feature",
        "type",
        r6("z_score").alias("z_score"),
        "frequency",
        "total_samples",
        r6("rarity_score").alias("rarity_score"),
        "deviation_level",
    )


@query(f"WITH {EVENTS_SQL} SELECT event_id, agent AS value, cnt AS frequency FROM res WHERE agents > 1"
    " UNION ALL SELECT event_id, tier, tier_cnt FROM res WHERE tier_cnt IS NOT NULL")
def frequency_join(spark, folder):
    """Training frequency of every event's category."""
    rows = _deviations(spark, folder)
    return rows.where("type = 'categorical'").select("event_id", "value", "frequency")


@query(
    f"WITH {EVENTS_SQL} SELECT event_id, round(value, 6) AS value, round(m_value, 6) AS mean, round(s_value, 6) AS std"
    " FROM res JOIN st USING (log_type)"
)
def stats_join(spark, folder):
    """Training statistics next to every event's value."""
    rows = _deviations(spark, folder)
    return rows.where("feature = 'value'").select(
        "event_id", r6(F.col("value").cast("double")).alias("value"), r6("mean").alias("mean"), r6("std").alias("std")
    )


@query(f"WITH {EVENTS_SQL} SELECT event_id, CAST(len(notable) AS INTEGER) AS n_notable FROM res WHERE n IS NOT NULL")
def notable_features(spark, folder):
    levels = "'high', 'extreme', 'rare', 'extremely_rare'"
    return _detected(spark, folder).where("error IS NULL").select(
        "event_id", F.expr(f"size(filter(feature_deviations, d -> d.deviation_level IN ({levels})))").alias("n_notable")
    )


@query(f"WITH {EVENTS_SQL} SELECT is_anomaly, explanation, count(*) AS n FROM res WHERE n IS NOT NULL GROUP BY ALL")
def explanation(spark, folder):
    found = _detected(spark, folder).where("error IS NULL")
    return found.groupBy("is_anomaly", "explanation").agg(F.count(F.lit(1)).alias("n"))


@query(
    "SELECT event_id, CASE event_type WHEN 'signup' THEN NULL ELSE 'Invalid Model' END AS log_type, CASE event_type WHEN 'signup'"
    " THEN 'No model available for log type: None' ELSE 'No model available for log type: Invalid Model' END AS error"
    " FROM events WHERE event_type IN ('signup', 'error')"
)
def error_rows(spark, folder):
    """Events without a model are kept with an error; one kind asks for a model that does not exist."""
    asked = security_events(spark, folder).withColumn("stated", F.when(F.col("severity").isNotNull(), "Invalid Model"))
    found = detect(asked, fixed_scorer(spark, folder), LIMIT, explicit="stated", keep=("event_id",))
    return found.where("error IS NOT NULL").select("event_id", "log_type", "error")


@query(f"WITH {EVENTS_SQL} SELECT event_id, round(decision, 6) AS anomaly_score FROM res WHERE is_anomaly")
def alert_filter(spark, folder):
    return alerts(_detected(spark, folder)).select("event_id", r6("anomaly_score").alias("anomaly_score"))


@query(
    f"WITH {EVENTS_SQL} SELECT event_id, decision < coalesce(CASE WHEN user_id % 2 = 0 THEN -0.05 END, -0.2) AS is_anomaly,"
    " coalesce(CASE WHEN user_id % 2 = 0 THEN -0.05 END, -0.2)::DOUBLE AS anomaly_threshold FROM res WHERE n IS NOT NULL"
)
def per_event_threshold(spark, folder):
    asked = security_events(spark, folder).withColumn("limit", F.when(F.col("user_id") % 2 == 0, -0.05))
    found = detect(asked, fixed_scorer(spark, folder), F.col("limit"), keep=("event_id",))
    return found.where("error IS NULL").select("event_id", "is_anomaly", "anomaly_threshold")


STEPS = (-0.08, -0.04, 0.0)


@query(
    f"WITH {EVENTS_SQL} SELECT event_id, t AS threshold, round(decision, 6) < t AS is_anomaly FROM res,"
    " (VALUES (-0.08::DOUBLE), (-0.04::DOUBLE), (0.0::DOUBLE)) v(t) WHERE n IS NOT NULL"
)
def threshold_cross(spark, folder):
    found = _detected(spark, folder).where("error IS NULL").withColumn("anomaly_score", r6("anomaly_score"))
    return reports.at_thresholds(found.select("event_id", "anomaly_score"), STEPS).drop("anomaly_score")


@query(
    f"WITH {EVENTS_SQL} SELECT log_type, t AS threshold, count(*) AS events, count(*) FILTER (round(decision, 6) < t) AS anomalies,"
    " round(avg(CASE WHEN round(decision, 6) < t THEN 1.0 ELSE 0 END), 6) AS anomaly_rate FROM res,"
    " (VALUES (-0.08::DOUBLE), (-0.04::DOUBLE), (0.0::DOUBLE)) v(t) WHERE n IS NOT NULL GROUP BY ALL"
)
def threshold_sweep(spark, folder):
    found = _detected(spark, folder).withColumn("anomaly_score", r6("anomaly_score"))
    sweep = reports.threshold_sweep(found, ["log_type"], STEPS)
    return sweep.withColumn("anomaly_rate", r6("anomaly_rate"))


@query(
    "SELECT event_id, CASE event_type WHEN 'view' THEN 'Missing ''event_data'' in request' WHEN 'purchase' THEN"
    " 'Invalid JSON in request body' WHEN 'signup' THEN 'anomaly_threshold must be a number' END AS error,"
    " CASE WHEN event_type IN ('click', 'error') THEN user_id END AS user_id,"
    " CASE event_type WHEN 'click' THEN 'AWS IAM' END AS log_type,"
    " CASE event_type WHEN 'click' THEN -0.35 WHEN 'error' THEN -0.2 END::DOUBLE AS anomaly_threshold FROM events"
)
def request_validation(spark, folder):
    kind = F.col("event_type")
    event = F.concat(F.lit('"event_data":{"user":{"id":'), F.col("user_id"), F.lit("}}"))
    body = (
        F.when(kind == "click", F.concat(F.lit("{"), event, F.lit(',"log_type":"AWS IAM","anomaly_threshold":-0.35}')))
        .when(kind == "view", F.lit('{"invalid_field":1}'))
        .when(kind == "purchase", F.concat(F.lit("{"), event))
        .when(kind == "signup", F.concat(F.lit("{"), event, F.lit(',"anomaly_threshold":"invalid"}')))
        .otherwise(F.concat(F.lit("{"), event, F.lit("}")))
    )
    asked = table(spark, folder, "events").select("event_id", body.alias("body"))
    schema = T.StructType.fromDDL("user struct<id:bigint>")
    return read_requests(asked, "body", schema).select(
        "event_id", "error", F.col("event_data.user.id").alias("user_id"), "log_type", "anomaly_threshold"
    )


REQUEST = "p_event_time string, eventsource string, user_id bigint, value double, tier string, agent string, props struct<k:bigint>"


@query(
    f"WITH {EVENTS_SQL}, q AS (SELECT *, CASE event_type WHEN 'click' THEN -0.35 WHEN 'view' THEN -0.2 END AS t,"
    " CASE event_type WHEN 'purchase' THEN 'Invalid JSON in request body' WHEN 'signup' THEN"
    " 'anomaly_threshold must be a number' WHEN 'error' THEN CASE WHEN user_id % 2 = 0 THEN 'Missing ''event_data'' in request'"
    " ELSE 'No model available for log type: None' END END AS problem FROM res)"
    " SELECT event_id, CASE WHEN problem IS NULL THEN log_type END AS log_type, CASE WHEN problem IS NULL THEN decision < t END AS"
    " is_anomaly, CASE WHEN problem IS NULL THEN round(decision, 6) END AS anomaly_score, t::DOUBLE AS anomaly_threshold,"
    " problem AS error FROM q"
)
def request_scoring(spark, folder):
    """Requests with all four kinds of error among scored ones."""
    kind = F.col("event_type")
    raw = security_events(spark, folder).join(table(spark, folder, "events").select("event_id", "event_type"), "event_id")
    event = F.struct(*T.StructType.fromDDL(REQUEST).names).alias("event_data")
    limited = F.to_json(F.struct(event, F.lit(-0.35).alias("anomaly_threshold")))
    body = (
        F.when(kind == "click", limited)
        .when(kind == "purchase", F.substring(limited, 1, 40))
        .when(kind == "signup", F.to_json(F.struct(event, F.lit("low").alias("anomaly_threshold"))))
        .when((kind == "error") & (F.col("user_id") % 2 == 0), F.lit('{"anomaly_threshold": 1}'))
        .otherwise(F.to_json(F.struct(event)))
    )
    asked = raw.select("event_id", body.alias("body"))
    schema = T.StructType.fromDDL(REQUEST)
    found = score_requests(asked, "body", schema, fixed_scorer(spark, folder), ("event_id",))
    return found.select(
        "event_id", "log_type", "is_anomaly", r6("anomaly_score").alias("anomaly_score"), "anomaly_threshold", "error"
    )


def _u(purpose: str) -> str:
    return f"(('0x' || substr(md5('42:' || event_id || ':' || feature || ':{purpose}'), 1, 8))::BIGINT / 4294967296.0)"


@query(
    f"""WITH {EVENTS_SQL},
vals AS (SELECT log_type, 'agent' AS feature, agent AS value, count(*) AS cnt FROM d JOIN st USING (log_type) WHERE agents > 1 GROUP BY ALL
  UNION ALL SELECT log_type, 'tier', tier, count(*) FROM d WHERE log_type IS NOT NULL AND tier IS NOT NULL GROUP BY ALL),
ladder AS (SELECT *, sum(cnt) OVER (PARTITION BY log_type, feature ORDER BY value) AS upto,
  sum(cnt) OVER (PARTITION BY log_type, feature) AS total,
  row_number() OVER (PARTITION BY log_type, feature ORDER BY cnt, value) AS place,
  count(*) OVER (PARTITION BY log_type, feature) AS size FROM vals),
ids AS (SELECT event_id, log_type, user_id % 2 = 0 AS anomalous, unnest(['agent', 'tier', 'hour', 'day_of_week', 'user_id',
  'value', 'props.k']) AS feature FROM d WHERE log_type IS NOT NULL),
draws AS (SELECT *, anomalous AND {_u('odd')} < 0.7 AS odd, {_u('pick')} AS pick, {_u('side')} AS side FROM ids),
num AS (SELECT dr.*, CASE feature {" ".join(
      f"WHEN '{f}' THEN m_{v} + s_{v} * CASE WHEN odd THEN CASE WHEN side < 0.5 THEN -1 ELSE 1 END * (3 + pick * 2)"
      f" ELSE pick * 4 - 2 END"
      for v, f in (("hour", "hour"), ("dow", "day_of_week"), ("user_id", "user_id"), ("value", "value"), ("k", "props.k"))
  )} END AS v FROM draws dr JOIN st USING (log_type))
SELECT event_id AS id, log_type, anomalous, feature, NULL AS text_value, round(CASE feature WHEN 'hour' THEN
  greatest(0, least(23, trunc(v))) WHEN 'day_of_week' THEN greatest(0, least(6, trunc(v))) ELSE v END, 6) AS number_value
FROM num WHERE feature NOT IN ('agent', 'tier')
UNION ALL
SELECT event_id, dr.log_type, anomalous, dr.feature, min_by(l.value, CASE WHEN odd THEN place ELSE upto END), NULL
FROM draws dr JOIN ladder l ON l.log_type = dr.log_type AND l.feature = dr.feature
  AND CASE WHEN odd THEN place = 1 + floor(pick * greatest(1, size // 10)) ELSE upto > floor(pick * total) END
GROUP BY ALL"""
)
def synthetic_events(spark, folder):
    """One synthetic event per logged event of a known type, half of them anomalous."""
    raw = flatten(security_events(spark, folder))
    ids = raw.select(
        F.col("event_id").alias("id"),
        route(raw, MODELS).alias("log_type"),
        (F.col("user_id") % 2 == 0).alias("anomalous"),
    )
    return synthesise(ids, fixed_model(spark, folder)).withColumn("number_value", r6("number_value"))
