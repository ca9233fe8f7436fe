"""Encoding, training and stored models."""

from __future__ import annotations

from pyspark.sql import SparkSession, functions as F

from ...functions.names import c
from ...functions.scoring import EULER
from ...operators import encode, forest as trees
from ...operators.detect import Scorer
from ...operators.profile import Profile, profile
from ...session import join_side, new_path, stage
from ...sources.models import Model, store_status
from .. import train
from .registry import query, remembered, table
from .views import SCORED_SQL, VIEW_COLUMNS, candidates_sql, log_view, profile_sql, r6, selection_sql

BY = ["log_type"]
# a few extreme events form a log type of their own that is too small to train
TYPES = "CASE WHEN value > 400 THEN 'rare' ELSE event_type END"
SELECTED_SQL = (
    f"{profile_sql(TYPES)}, {candidates_sql()}, big AS (SELECT * FROM cand WHERE n >= 100), "
    + SCORED_SQL.replace("FROM cand", "FROM big")
    + f", {selection_sql((0.6, 0.5, 0.3, 0.1), 10)},"
    " slots AS (SELECT *, row_number() OVER (PARTITION BY log_type ORDER BY is_category DESC, rank) - 1 AS slot FROM sel)"
)


@remembered("events")
def _fitted(spark: SparkSession, folder: str) -> Model:
    return train.fit(log_view(spark, folder, TYPES), row_key=["event_id"], columns=VIEW_COLUMNS)


@remembered("events")
def _untrained(spark: SparkSession, folder: str) -> Model:
    """Feature and value tables only; enough to encode."""
    found = profile(log_view(spark, folder, TYPES), BY, columns=VIEW_COLUMNS)
    found = Profile(BY, stage(found.features, "profile"), found.counts)
    features = stage(train.model_features(found), "features")
    values = stage(encode.fit_values(features, found.counts, BY), "values")
    sizes = features.groupBy("log_type").agg(F.max("rows").alias("training_samples"))
    models = sizes.withColumns({"psi": F.lit(256), "offset": F.lit(0.0)})
    return Model(models, features, values, features)


VALUES_SQL = """encoded AS (
  SELECT log_type, slot, feature, value, CAST(sum(cnt) AS BIGINT) AS cnt, bool_or(is_category) AS is_category FROM (
    SELECT s.log_type, s.slot, s.feature, s.is_category, v.value, v.cnt FROM vc v JOIN slots s USING (log_type, feature)
    WHERE s.is_category OR s.type = 'categorical'
    UNION ALL SELECT log_type, slot, feature, is_category, 'unknown', 0 FROM slots
    WHERE is_category AND feature IN ('flag', 'tier') AND total < n)
  GROUP BY ALL),
codes AS (SELECT *, CASE WHEN is_category THEN CAST(row_number() OVER (PARTITION BY log_type, feature ORDER BY value) - 1
  AS INTEGER) END AS code FROM encoded)"""


@query(f"WITH {SELECTED_SQL}, {VALUES_SQL} SELECT log_type, feature, value, code, cnt FROM codes")
def label_encode_fit(spark, folder):
    return _untrained(spark, folder).values.select("log_type", "feature", "value", "code", "cnt")


@query(
    f"WITH {SELECTED_SQL}, {VALUES_SQL}, o AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'click' WHEN 'O' THEN 'view'"
    " ELSE 'error' END AS log_type, 'agent-' || o_custkey AS agent, CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice"
    " > 100000 THEN 'huge' END AS tier FROM orders),"
    " unk AS (SELECT log_type, feature, code FROM codes WHERE value = 'unknown')"
    " SELECT o_orderkey, CAST(coalesce(a.code, 0) AS INTEGER) AS agent_code, CAST(coalesce(t.code, u.code, 0) AS INTEGER) AS tier_code"
    " FROM o LEFT JOIN codes a ON a.log_type = o.log_type AND a.feature = 'agent' AND a.value = o.agent"
    " LEFT JOIN codes t ON t.log_type = o.log_type AND t.feature = 'tier' AND t.value = coalesce(o.tier, 'unknown')"
    " LEFT JOIN unk u ON u.log_type = o.log_type AND u.feature = 'tier'"
)
def label_code_join(spark, folder):
    """Orders encoded with codes learnt from events: many agents and one tier are unseen."""
    scorer = Scorer(_untrained(spark, folder))
    status = F.col("o_orderstatus")
    events = table(spark, folder, "orders").select(
        "o_orderkey",
        F.when(status == "F", "click").when(status == "O", "view").otherwise("error").alias("log_type"),
        F.concat(F.lit("agent-"), F.col("o_custkey")).alias("agent"),
        F.when(F.col("o_totalprice") > 300000, "high").when(F.col("o_totalprice") > 100000, "huge").alias("tier"),
    )
    encoded = scorer.encode(events, ["o_orderkey"])

    def code(feature: str):
        found = F.lit(0)
        for i in range(scorer.slots):
            found = F.when(F.get("s_feature", F.lit(i)) == feature, F.col(f"x_{i}").cast("int")).otherwise(found)
        return found

    return encoded.select("o_orderkey", code("agent").alias("agent_code"), code("tier").alias("tier_code"))


@query(
    "SELECT event_type AS log_type, round(m, 6) AS fill_median, round(avg(coalesce(b, m)), 6) AS scale_mean,"
    " round(stddev_pop(coalesce(b, m)), 6) AS scale_std FROM (SELECT event_type, CASE WHEN value > 40 THEN value END AS b,"
    " quantile_cont(CASE WHEN value > 40 THEN value END, 0.5) OVER (PARTITION BY event_type) AS m FROM events) GROUP BY event_type, m"
)
def standard_scale(spark, folder):
    """Imputation median and scaling of a number with many gaps."""
    sparse = table(spark, folder, "events").select(
        F.col("event_type").alias("log_type"), F.when(F.col("value") > 40, F.col("value")).alias("bytes")
    )
    features = profile(sparse, BY).features.where("feature = 'bytes'")
    fitted = encode.fit_scalers(features)
    return fitted.select("log_type", *[r6(n).alias(n) for n in ("fill_median", "scale_mean", "scale_std")])


@query(
    "WITH s AS (SELECT event_id, event_type, CASE WHEN value > 40 THEN value END AS b FROM events),"
    " m AS (SELECT event_type, quantile_cont(b, 0.5) AS med FROM s GROUP BY event_type)"
    " SELECT event_id, round(coalesce(b, med), 6) AS bytes FROM s JOIN m USING (event_type)"
)
def median_impute(spark, folder):
    sparse = table(spark, folder, "events").select(
        "event_id", F.col("event_type").alias("log_type"), F.when(F.col("value") > 40, F.col("value")).alias("bytes")
    )
    medians = profile(sparse, BY, columns=["bytes"]).features.select("log_type", "median")
    return sparse.join(join_side(medians, "medians"), "log_type").select(
        "event_id", r6(encode.impute(F.col("bytes"), F.col("median"))).alias("bytes")
    )


_SCALED = ["user_id", "value", "props.k", "hour", "day_of_week"]


CELLS_SQL = (
    "txt AS (SELECT lg.log_type, event_id, f.feature, coalesce(f.v, 'unknown') AS value FROM"
    " (SELECT *, unnest([{'feature': 'dst_port', 'v': CAST(dst_port AS VARCHAR)}, {'feature': 'flag', 'v': CASE flag WHEN true"
    " THEN 'True' WHEN false THEN 'False' END}, {'feature': 'tier', 'v': tier}, {'feature': 'agent', 'v': agent}]) AS f FROM lg) lg),"
    " nums AS (SELECT log_type, event_id, f.feature, f.v, avg(f.v) OVER w AS m, stddev_pop(f.v) OVER w AS s FROM (SELECT *, unnest(["
    + ", ".join(f"{{'feature': '{n}', 'v': CAST(\"{n}\" AS DOUBLE)}}" for n in [*_SCALED, "active"])
    + "]) AS f FROM lg) WINDOW w AS (PARTITION BY log_type, f.feature)),"
    " cells AS (SELECT log_type, event_id, CAST(slot AS INTEGER) AS slot, CAST(code AS DOUBLE) AS x FROM txt"
    " JOIN codes USING (log_type, feature, value)"
    " UNION ALL SELECT log_type, event_id, CAST(slot AS INTEGER), (v - m) / s FROM nums JOIN slots USING (log_type, feature))"
)


@query(f"WITH {SELECTED_SQL}, {VALUES_SQL}, {CELLS_SQL} SELECT event_id, slot, round(x, 6) AS x FROM cells")
def feature_matrix(spark, folder):
    """Every cell of the model matrix: label codes, then scaled numbers. A slot that a log type leaves empty is no cell."""
    scorer = Scorer(_untrained(spark, folder))
    encoded = scorer.encode(log_view(spark, folder, TYPES), ["event_id"], "median", "inner")
    cells = [F.struct(F.lit(i).alias("slot"), r6(x).alias("x")) for i, x in enumerate(scorer.matrix)]
    filled = [F.when(F.get("s_feature", F.lit(i)).isNotNull(), cell) for i, cell in enumerate(cells)]
    return encoded.select("event_id", F.inline(F.array_compact(F.array(*filled))))


def _uniform_sql(text: str, at: int = 1) -> str:
    return f"('0x' || substr(md5({text}), {at}, {trees.DIGITS}))::BIGINT / {float(16**trees.DIGITS)}"


def _cut_sql(rows: str) -> str:
    """What splits each node of ``rows`` (with low, high and n): the feature and threshold, null for leaves."""
    name = f"'{trees.SEED}:' || log_type || ':' || tree || ':' || node"
    return (
        f"SELECT *, CASE WHEN raw >= high[f + 1] THEN low[f + 1] ELSE raw END AS cut FROM (SELECT *, low[f + 1]"
        f" + {_uniform_sql(name, 1 + trees.DIGITS)} * (high[f + 1] - low[f + 1]) AS raw FROM (SELECT *, CASE WHEN depth < deepest"
        f" AND n > 1 AND len(free) > 0 THEN free[1 + floor({_uniform_sql(name)} * len(free))::INT] END AS f FROM (SELECT *,"
        f" list_filter(range({WIDTH}), lambda i: low[i + 1] < high[i + 1]) AS free FROM ({rows}))))"
    )


def _ends_sql(over: str) -> str:
    low, high = (", ".join(f"{which}(x[{i + 1}]){over}" for i in range(WIDTH)) for which in ("min", "max"))
    return f"[{low}] AS low, [{high}] AS high, count(*){over} AS n"


WIDTH = 10  # features of a model at most
AVERAGE_SQL = f"CASE WHEN {{n}} <= 1 THEN 0.0 WHEN {{n}} = 2 THEN 1.0 ELSE 2 * (ln({{n}} - 1.0) + {EULER}) - 2.0 * ({{n}} - 1) / {{n}} END"
# The forest itself: rows drawn and trees grown by digests, level by level.
FOREST_SQL = (
    f"{SELECTED_SQL}, {VALUES_SQL}, {CELLS_SQL},"
    " mat AS MATERIALIZED (SELECT log_type, event_id, list(x ORDER BY slot) AS x FROM cells GROUP BY ALL),"
    " per AS (SELECT *, least(100, greatest(1, floor(1 / p)::INT)) AS per_draw FROM (SELECT log_type, least(256, count(*)) AS psi,"
    " least(1.0, (least(256, count(*)) + 8 * sqrt(least(256, count(*)))) / count(*)) AS p FROM mat GROUP BY log_type)),"
    " hits AS (SELECT *, floor(u / p)::INT AS place FROM (SELECT *,"
    f" {_uniform_sql(f"event_id || ':' || r || ':{trees.SEED}'")} AS u FROM (SELECT mat.*, p, per_draw,"
    " unnest(range(ceil(100 / per_draw)::INT)) AS r FROM mat JOIN per USING (log_type)))),"
    " sample AS MATERIALIZED (SELECT log_type, event_id, x, r * per_draw + place AS tree FROM hits WHERE place < per_draw AND"
    " r * per_draw + place < 100 QUALIFY row_number() OVER (PARTITION BY log_type, tree ORDER BY u, event_id::VARCHAR) <= 256),"
    " grown AS (SELECT *, 1::BIGINT AS node, 0 AS depth, ceil(log2(greatest(2, count(*) OVER (PARTITION BY log_type, tree))))::INT"
    " AS deepest FROM sample UNION ALL SELECT log_type, event_id, x, tree, 2 * node + (x[f + 1] > cut)::INT, depth + 1, deepest FROM ("
    + _cut_sql(f"SELECT *, {_ends_sql(' OVER w')} FROM grown WINDOW w AS (PARTITION BY log_type, tree, node)")
    + ") WHERE f IS NOT NULL),"
    " nodes AS MATERIALIZED (SELECT log_type, tree, node, f AS feature, CASE WHEN f IS NOT NULL THEN cut END AS threshold,"
    f" CASE WHEN f IS NULL THEN depth + {AVERAGE_SQL.format(n='n')} END AS path_length, n AS node_rows FROM ("
    + _cut_sql(f"SELECT log_type, tree, node, depth, deepest, {_ends_sql('')} FROM grown GROUP BY ALL")
    + "))"
)


@query(
    f"WITH RECURSIVE {FOREST_SQL} SELECT log_type, tree::INT AS tree, node::INT AS node, feature::INT AS feature,"
    " round(threshold, 6) AS threshold, round(path_length, 6) AS path_length, node_rows::INT AS node_rows FROM nodes"
)
def forest_fit(spark, folder):
    """Every node of the grown trees, with the rows that reached it."""
    return _fitted(spark, folder).forest.select(
        "log_type", "tree", "node", "feature", r6("threshold").alias("threshold"), r6("path_length").alias("path_length"), "node_rows"
    )


@query(
    f"SELECT log_type, 100 AS trees, true AS full_binary, true AS within_depth FROM (SELECT {TYPES} AS log_type FROM events)"
    " GROUP BY log_type HAVING count(*) >= 100"
)
def forest_shape(spark, folder):
    """Per log type: number of trees, every split has two children, no node below the depth limit of 8."""
    nodes = _fitted(spark, folder).forest
    per_tree = nodes.groupBy("log_type", "tree").agg(
        (2 * F.count("threshold") + 1 == F.count(F.lit(1))).alias("full"), F.max("node").alias("deepest")
    )
    return per_tree.groupBy("log_type").agg(
        F.count("tree").cast("int").alias("trees"),
        F.bool_and("full").alias("full_binary"),
        F.bool_and(F.col("deepest") < 2**9).alias("within_depth"),
    )


@query(
    f"WITH {SELECTED_SQL} SELECT log_type, string_agg(CASE WHEN is_category THEN feature END, ',' ORDER BY slot) AS categorical,"
    " string_agg(CASE WHEN NOT is_category THEN feature END, ',' ORDER BY slot) AS numerical, max(n) AS training_samples,"
    " CAST(least(256, max(n)) AS INTEGER) AS psi, '100' AS n_estimators FROM slots GROUP BY log_type"
)
def model_metadata(spark, folder):
    return _fitted(spark, folder).models.select(
        "log_type",
        F.array_join("categorical_features", ",").alias("categorical"),
        F.array_join("numerical_features", ",").alias("numerical"),
        "training_samples",
        "psi",
        F.col("params")["n_estimators"].alias("n_estimators"),
    )


@query(f"WITH {SELECTED_SQL} SELECT log_type, CAST(slot AS INTEGER) AS slot, feature, type, is_category, n AS rows FROM slots")
def model_roundtrip(spark, folder):
    """Models saved per log type and loaded again."""
    path = new_path(spark, "models")
    _fitted(spark, folder).save(path)
    return Model.load(spark, path).features.select("log_type", "slot", "feature", "type", "is_category", "rows")


@query(
    f"WITH {SELECTED_SQL}, done AS (SELECT log_type, count(*) FILTER (is_category) AS n_categorical,"
    " count(*) FILTER (NOT is_category) AS n_numerical FROM slots GROUP BY log_type)"
    " SELECT log_type, samples, n_categorical, n_numerical, CASE WHEN n_categorical IS NOT NULL THEN 'SUCCESS' WHEN samples < 100"
    " THEN 'FAILED - insufficient data' ELSE 'FAILED - no suitable features' END AS status"
    f" FROM (SELECT {TYPES} AS log_type, count(*) AS samples FROM events GROUP BY ALL) LEFT JOIN done USING (log_type)"
)
def training_summary(spark, folder):
    logs = table(spark, folder, "events").withColumn("log_type", F.expr(TYPES))
    return train.training_report(logs, _fitted(spark, folder))


@query(
    f"WITH {SELECTED_SQL} SELECT log_type, count(*) FILTER (is_category) AS n_categorical,"
    " count(*) FILTER (NOT is_category) AS n_numerical, count(*) AS n_features, max(n) AS training_samples,"
    " count(*) BETWEEN 4 AND 7 AS in_range FROM slots GROUP BY log_type"
)
def model_validation(spark, folder):
    return train.validate_models(_fitted(spark, folder).models)


@query(
    f"SELECT log_type, true AS calibrated FROM (SELECT {TYPES} AS log_type FROM events) GROUP BY log_type HAVING count(*) >= 100"
)
def multi_log_type_train(spark, folder):
    """All log types trained in one job; the share of training rows below the offset is the contamination."""
    models = _fitted(spark, folder).models
    return models.select("log_type", (F.abs(F.col("anomaly_rate") - trees.CONTAMINATION) < 0.01).alias("calibrated"))


@query(
    f"WITH RECURSIVE {FOREST_SQL}, walk AS (SELECT log_type, event_id, t.tree, 1::BIGINT AS node FROM mat, range(100) t(tree)"
    " UNION ALL SELECT w.log_type, w.event_id, w.tree, 2 * w.node + (m.x[o.feature + 1] > o.threshold)::INT FROM walk w"
    " JOIN nodes o ON o.log_type = w.log_type AND o.tree = w.tree AND o.node = w.node JOIN mat m ON m.event_id = w.event_id"
    " AND m.log_type = w.log_type WHERE o.feature IS NOT NULL),"
    f" scores AS (SELECT log_type, event_id, -pow(2.0, -avg(path_length) / any_value({AVERAGE_SQL.format(n='psi')})) AS score"
    " FROM walk JOIN nodes USING (log_type, tree, node) JOIN per USING (log_type) WHERE path_length IS NOT NULL GROUP BY log_type, event_id)"
    " SELECT event_id, log_type, round(score - quantile_cont(score, 0.1) OVER (PARTITION BY log_type), 6) AS decision FROM scores"
)
def training_scores(spark, folder):
    """Decision values of the whole log under the trained forest."""
    scorer = Scorer(_fitted(spark, folder))
    scored = scorer.score(scorer.encode(log_view(spark, folder, TYPES), ["event_id"], "median", "inner"))
    return scored.select("event_id", c("log_type"), r6(F.col("score") - F.col("offset")).alias("decision"))


INFINITE = "click"
BROKEN = "view"


@query(
    f"WITH {SELECTED_SQL}, done AS (SELECT log_type, count(*) FILTER (is_category) AS n_categorical,"
    " count(*) FILTER (NOT is_category) AS n_numerical FROM slots GROUP BY log_type)"
    f" SELECT log_type, samples, CASE WHEN log_type <> '{INFINITE}' THEN n_categorical END AS n_categorical,"
    f" CASE WHEN log_type <> '{INFINITE}' THEN n_numerical END AS n_numerical, CASE WHEN log_type = '{INFINITE}'"
    f" THEN 'FAILED - value: {trees.NOT_FINITE}' WHEN n_categorical IS NOT NULL THEN 'SUCCESS' WHEN samples < 100"
    " THEN 'FAILED - insufficient data' ELSE 'FAILED - no suitable features' END AS status"
    f" FROM (SELECT {TYPES} AS log_type, count(*) AS samples FROM events GROUP BY ALL) LEFT JOIN done USING (log_type)"
)
def training_with_failure(spark, folder):
    """Training over all log types of which one holds an infinite number: the others get their models."""
    logs = log_view(spark, folder, TYPES)
    odd = (F.col("log_type") == INFINITE) & (F.col("event_id") % 50 == 0)
    logs = logs.withColumn("value", F.when(odd, float("inf")).otherwise(F.col("value")))
    model = train.fit(logs, row_key=["event_id"], columns=VIEW_COLUMNS)
    return train.training_report(logs, model)


@query(
    f"WITH {SELECTED_SQL}, kinds AS (SELECT log_type, count(*) AS slots FROM slots GROUP BY log_type) SELECT log_type,"
    f" CASE WHEN log_type = '{BROKEN}' THEN 'features: 0 of ' || slots || ' rows' ELSE 'loaded' END AS status,"
    f" CASE WHEN log_type <> '{BROKEN}' THEN 100 END AS trees FROM kinds"
)
def model_store_status(spark, folder):
    """A store whose features of one log type were lost: what is loaded of it, and what is said of the rest."""
    path = new_path(spark, "models")
    version = _fitted(spark, folder).save(path)
    lost = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/features/version={version}/log_type={BROKEN}")
    lost.getFileSystem(spark._jsc.hadoopConfiguration()).delete(lost, True)
    loaded = Model.load(spark, path).forest.groupBy("log_type").agg(F.countDistinct("tree").cast("int").alias("trees"))
    return store_status(spark, path).join(loaded, "log_type", "left").select("log_type", "status", "trees")
