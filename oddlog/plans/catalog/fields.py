"""Flattening, field sets, time features and scalar functions."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ...functions import scoring, timefeat
from ...functions.names import is_port
from ...functions.text import canonical_text
from ...operators import encode, variants
from ...operators.flatten import (
    field_set_diff as add_field_sets,
    flatten,
    json_schema,
    parse_json,
    prepare,
    presence_counts,
    record_size as row_bytes,
)
from ...operators.quantiles import exact_quantiles
from ...session import join_side
from .registry import query, table
from .views import K_SQL, events, r6


@query(f"""SELECT event_id, user_id AS "actor.id", event_type AS "actor.session.kind", {K_SQL} AS "actor.session.props.k" FROM events""")
def flatten_struct(spark, folder):
    nested = events(spark, folder).select(
        "event_id",
        F.struct(
            F.col("user_id").alias("id"), F.struct(F.col("event_type").alias("kind"), F.col("props")).alias("session")
        ).alias("actor"),
    )
    return flatten(nested)


@query(
    "SELECT conv_id, turn, CAST(len(string_split(text, ' ')) AS INTEGER) AS words_count,"
    " string_split(text, ' ')[1] AS words_first FROM conversations"
)
def flatten_scalar_array(spark, folder):
    words = table(spark, folder, "conversations").select("conv_id", "turn", F.split("text", " ").alias("words"))
    return flatten(words)


@query(
    "SELECT event_id, "
    + ", ".join(
        f'CASE WHEN n > {i} THEN CAST({i + 1} AS INTEGER) END AS "items[{i}].rank",'
        f' CASE WHEN n > {i} THEN round(value * {i + 1}, 6) END AS "items[{i}].amount"'
        for i in range(5)
    )
    + f" FROM (SELECT event_id, value, {K_SQL} % 8 AS n FROM events)"
)
def flatten_object_array(spark, folder):
    """Arrays of up to seven objects; five are kept."""
    count = (F.col("props.k") % 8).cast("int")
    items = F.when(
        count > 0,
        F.transform(
            F.sequence(F.lit(1), count),
            lambda i: F.struct(i.alias("rank"), F.round(F.col("value") * i, 6).alias("amount")),
        ),
    )
    return flatten(events(spark, folder).select("event_id", items.alias("items")))


@query(
    """SELECT event_id, CASE WHEN event_type = 'click' THEN user_id END AS "body.button",
  CASE WHEN event_type = 'view' THEN event_type END AS "body.page.name",
  CASE WHEN event_type = 'purchase' THEN value END AS "body.price",
  CASE WHEN event_type NOT IN ('click', 'view', 'purchase') THEN event_type ELSE 'known' END AS "body.state" FROM events"""
)
def schema_union(spark, folder):
    """Records with different keys per kind; the columns are the union over all rows."""
    kind = F.col("event_type")
    extra = (
        F.when(kind == "click", F.concat(F.lit(',"button":'), F.col("user_id")))
        .when(kind == "view", F.lit(',"page":{"name":"view"}'))
        .when(kind == "purchase", F.concat(F.lit(',"price":'), F.col("value")))
        .otherwise("")
    )
    state = F.when(kind.isin("click", "view", "purchase"), "known").otherwise(kind)
    body = F.concat(F.lit('{"state":"'), state, F.lit('"'), extra, F.lit("}"))
    raw = table(spark, folder, "events").select("event_id", body.alias("body"))
    return flatten(parse_json(raw, "body", json_schema(raw, "body")))


def _sparse(spark, folder):
    return table(spark, folder, "events").select(
        "event_id",
        F.nullif("event_type", F.lit("view")).alias("eventName"),
        F.when(F.col("value") > 40, F.col("value")).alias("bytes"),
        F.when(F.col("user_id") % 3 == 0, F.col("user_id")).alias("account"),
    )


@query(
    "SELECT event_id, CAST(f AS INTEGER) AS features_found, CAST(4 - f AS INTEGER) AS features_missing FROM (SELECT event_id,"
    " CAST(event_type <> 'view' AS INT) + CAST(value > 40 AS INT) + CAST(user_id % 3 = 0 AS INT) AS f FROM events)"
)
def feature_presence(spark, folder):
    counted = presence_counts(_sparse(spark, folder), ["eventName", "bytes", "account", "packets"])
    return counted.select("event_id", "features_found", "features_missing")


@query(
    "SELECT event_id, concat_ws(',', CASE WHEN event_type <> 'view' THEN 'eventName' END,"
    " CASE WHEN value > 40 THEN 'bytes' END) AS common_fields,"
    " concat_ws(',', CASE WHEN event_type = 'view' THEN 'eventName' END, CASE WHEN value <= 40 THEN 'bytes' END, 'packets')"
    " AS missing_in_event,"
    " concat_ws(',', 'event_id', CASE WHEN user_id % 3 = 0 THEN 'account' END) AS missing_in_model FROM events"
)
def field_set_diff(spark, folder):
    sets = add_field_sets(_sparse(spark, folder), ["eventName", "bytes", "packets"])
    names = ("common_fields", "missing_in_event", "missing_in_model")
    return sets.select("event_id", *[F.array_join(n, ",").alias(n) for n in names])


@query("SELECT feature FROM (SELECT lang AS feature FROM documents INTERSECT SELECT substr(source, 1, 2) FROM documents"
       " UNION SELECT DISTINCT source FROM documents WHERE source NOT IN (SELECT lang FROM documents))")
def field_set_tables(spark, folder):
    """Set operations on name tables: intersection, and the difference."""
    docs = table(spark, folder, "documents")
    lang, source = docs.select(F.col("lang").alias("feature")), docs.select(F.col("source").alias("feature"))
    prefix = docs.select(F.substring("source", 1, 2).alias("feature"))
    return lang.intersect(prefix).union(source.distinct().exceptAll(lang.distinct())).distinct()


@query(
    "SELECT o_orderkey, CAST(strlen('{\"o_orderkey\":' || o_orderkey || ',\"o_custkey\":' || o_custkey ||"
    " ',\"o_orderpriority\":\"' || o_orderpriority || '\"}') AS INTEGER) AS bytes FROM orders"
)
def record_size(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return orders.select("o_orderkey", row_bytes(orders).alias("bytes"))


# ---- time -----------------------------------------------------------------------------------------------------------


def _written(spark, folder, suffix: str):
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(suffix))
    return table(spark, folder, "events").select("event_id", text.alias("p_event_time"))


@query("SELECT event_id, CAST(hour(ts) AS INTEGER) AS hour FROM events")
def hour_feature(spark, folder):
    return prepare(_written(spark, folder, "+05:30")).select("event_id", "hour")


@query("SELECT event_id, CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week FROM events")
def day_of_week_feature(spark, folder):
    return prepare(_written(spark, folder, "Z")).select("event_id", "day_of_week")


@query(
    "SELECT event_id, CAST(CASE WHEN event_type = 'view' OR event_type = 'click' THEN NULL WHEN event_type = 'error' THEN -1"
    " ELSE hour(ts) END AS INTEGER) AS hour, CAST(CASE WHEN event_type = 'view' OR event_type = 'click' THEN NULL"
    " WHEN event_type = 'error' THEN -1 ELSE isodow(ts) - 1 END AS INTEGER) AS day_of_week FROM events"
)
def bad_timestamp_sentinel(spark, folder):
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    kind = F.col("event_type")
    written = (
        F.when(kind == "view", "").when(kind == "error", F.concat(F.lit("x"), text)).when(kind != "click", text)
    )
    return prepare(table(spark, folder, "events").select("event_id", written.alias("timestamp"))).drop("timestamp")


@query("SELECT event_id, ts - INTERVAL 330 MINUTE AS utc FROM (SELECT event_id, date_trunc('second', ts) AS ts FROM events)")
def utc_instant(spark, folder):
    written = _written(spark, folder, "+05:30")
    return written.select("event_id", timefeat.instant(F.col("p_event_time"), written.schema["p_event_time"].dataType).alias("utc"))


# ---- scalars --------------------------------------------------------------------------------------------------------


@query(
    "SELECT word, contains(lower(word), 'port') AS is_port, count(*) AS n FROM"
    " (SELECT unnest(string_split(text, ' ')) AS word FROM documents) GROUP BY ALL"
)
def port_field_flag(spark, folder):
    """Every word of every document taken as a field name."""
    words = table(spark, folder, "documents").select(F.explode(F.split("text", " ")).alias("word"))
    counted = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("word", is_port(F.col("word")).alias("is_port"), "n")


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS number FROM events")
def numeric_coerce(spark, folder):
    text = F.when(F.col("event_type") == "error", "n/a").otherwise(F.col("value").cast("string"))
    return table(spark, folder, "events").select("event_id", text.try_cast("double").alias("number"))


@query(
    "SELECT event_id, coalesce(nullif(event_type, 'view'), 'unknown') AS kind,"
    " CASE WHEN value > 40 THEN value ELSE 0 END AS bytes_zero,"
    " CASE WHEN value > 40 THEN value ELSE (SELECT quantile_cont(value, 0.5) FROM events WHERE value > 40) END AS bytes_median"
    " FROM events"
)
def null_fill(spark, folder):
    sparse = _sparse(spark, folder).withColumn("feature", F.lit("bytes"))
    median = exact_quantiles(sparse, ["feature"], {"median": 0.5}, "bytes")  # a single row
    return sparse.join(join_side(median, "median"), "feature").select(
        "event_id",
        F.coalesce("eventName", F.lit(encode.UNKNOWN)).alias("kind"),
        encode.impute(F.col("bytes"), F.lit(0.0)).alias("bytes_zero"),
        encode.impute(F.col("bytes"), F.col("median")).alias("bytes_median"),
    )


@query(
    "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity = floor(l_quantity) THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR)"
    " END AS quantity, CASE WHEN l_returnflag = 'R' THEN 'True' ELSE 'False' END AS returned FROM lineitem"
)
def canonical_values(spark, folder):
    lines = table(spark, folder, "lineitem").withColumn("returned", F.col("l_returnflag") == "R")
    return lines.select(
        "l_orderkey",
        "l_linenumber",
        canonical_text(F.col("l_quantity"), lines.schema["l_quantity"].dataType).alias("quantity"),
        canonical_text(F.col("returned"), lines.schema["returned"].dataType).alias("returned"),
    )


BASE_SQL = "base AS (SELECT event_type, avg(value) AS m, stddev_samp(value) AS s FROM events GROUP BY event_type)"


def _against_baseline(spark, folder):
    """Events next to mean and deviation of their type."""
    ev = table(spark, folder, "events")
    base = ev.groupBy("event_type").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"))
    return ev.join(join_side(base, "baseline"), "event_type")


@query(f"WITH {BASE_SQL} SELECT event_id, round((value - m) / s, 6) AS z FROM events JOIN base USING (event_type)")
def z_score(spark, folder):
    return _against_baseline(spark, folder).select(
        "event_id", r6(scoring.z_score(F.col("value"), F.col("m"), F.col("s"))).alias("z")
    )


@query(
    f"WITH {BASE_SQL} SELECT event_id, CASE WHEN abs(z) > 3 THEN 'extreme' WHEN abs(z) > 2 THEN 'high' WHEN abs(z) > 1 THEN"
    " 'moderate' ELSE 'normal' END AS level FROM (SELECT event_id, (value - m) / s AS z FROM events JOIN base USING (event_type))"
)
def deviation_level(spark, folder):
    z = scoring.z_score(F.col("value"), F.col("m"), F.col("s"))
    return _against_baseline(spark, folder).select("event_id", scoring.deviation_level(z).alias("level"))


RARITY_SQL = (
    "SELECT o_orderkey, 1 - CASE WHEN n IS NULL THEN 0 ELSE n END / (SELECT count(*) FROM events) AS r FROM orders LEFT JOIN"
    " (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) ON o_custkey = user_id"
)


def _rarity_of_customers(spark, folder):
    """Rarity of every order's customer among the users of the event log; customers without events are unseen."""
    ev, orders = table(spark, folder, "events"), table(spark, folder, "orders")
    counts = ev.groupBy(F.col("user_id").alias("o_custkey")).agg(F.count(F.lit(1)).alias("n"))
    total = F.broadcast(ev.agg(F.count(F.lit(1)).alias("total")))  # one row
    seen = orders.join(join_side(counts, "counts"), "o_custkey", "left").crossJoin(total)
    return seen.select("o_orderkey", scoring.rarity(F.col("n"), F.col("total")).alias("r"))


@query(f"SELECT o_orderkey, round(r, 6) AS rarity_score FROM ({RARITY_SQL})")
def rarity(spark, folder):
    return _rarity_of_customers(spark, folder).select("o_orderkey", r6("r").alias("rarity_score"))


@query(
    "SELECT l_orderkey, l_linenumber, CASE WHEN r > 0.95 THEN 'extremely_rare' WHEN r > 0.8 THEN 'rare' WHEN r > 0.5 THEN"
    " 'uncommon' ELSE 'common' END AS level FROM (SELECT l_orderkey, l_linenumber, 1 - n / t AS r FROM lineitem JOIN"
    " (SELECT l_returnflag, l_quantity >= 45 AS big, count(*) AS n FROM lineitem GROUP BY ALL) c"
    " ON lineitem.l_returnflag = c.l_returnflag AND (lineitem.l_quantity >= 45) = c.big,"
    " (SELECT count(*) AS t FROM lineitem))"
)
def rarity_level(spark, folder):
    lines = table(spark, folder, "lineitem").withColumn("big", F.col("l_quantity") >= 45)
    counts = lines.groupBy("l_returnflag", "big").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("total", F.sum("n").over(Window.partitionBy()))  # two rows per flag
    score = scoring.rarity(F.col("n"), F.col("total"))
    return lines.join(join_side(counts, "counts"), ["l_returnflag", "big"]).select(
        "l_orderkey", "l_linenumber", scoring.rarity_level(score).alias("level")
    )


def _loose_logs(spark, folder):
    """Events as JSON texts of four shapes: the time null, absent, good or bad; the user an object, null, text or absent."""
    ident, time = F.col("event_id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    shape = ident % 4
    body = (
        F.when(shape == 0, F.format_string('"p_event_time":null,"timestamp":"%s","user":{"id":%d}', time, "user_id"))
        .when(shape == 1, F.lit('"user":null'))
        .when(shape == 2, F.format_string('"p_event_time":"%s","user":"u%d"', time, "user_id"))
        .otherwise(F.format_string('"timestamp":"no time","tags":["%s",%d]', "event_type", "user_id"))
    )
    text = F.concat(F.format_string('{"id":%d,', ident), body, F.lit("}"))
    return table(spark, folder, "events").select("event_id", text.alias("body"))


_TIME_TEXT = "strftime(ts, '%Y-%m-%d %H:%M:%S')"


@query(
    f"SELECT event_id, event_id AS id, CASE WHEN event_id % 4 = 2 THEN {_TIME_TEXT} END AS p_event_time,"
    f" CASE event_id % 4 WHEN 0 THEN {_TIME_TEXT} WHEN 3 THEN 'no time' END AS \"timestamp\","
    " CASE WHEN event_id % 4 = 2 THEN 'u' || user_id END AS \"user\","
    " CASE WHEN event_id % 4 = 0 THEN CAST(user_id AS BIGINT) END AS \"user.id\","
    " CASE WHEN event_id % 4 = 3 THEN CAST(2 AS INTEGER) END AS tags_count, CASE WHEN event_id % 4 = 3 THEN event_type END AS tags_first"
    " FROM events"
)
def flatten_variant(spark, folder):
    """Logs without a schema, whose user is an object in some rows and a text in others."""
    return variants.flatten_variant(_loose_logs(spark, folder), "body")


@query(
    "SELECT event_id, CAST(CASE event_id % 4 WHEN 1 THEN NULL WHEN 2 THEN hour(ts) ELSE -1 END AS INTEGER) AS hour,"
    " CAST(CASE event_id % 4 WHEN 1 THEN NULL WHEN 2 THEN isodow(ts) - 1 ELSE -1 END AS INTEGER) AS day_of_week,"
    " CASE event_id % 4 WHEN 0 THEN 'p_event_time' WHEN 1 THEN 'user' ELSE '' END AS nulls FROM events"
)
def variant_null_time(spark, folder):
    """A time stated as null gives -1, an absent one null; what a row states as null is named."""
    loose = _loose_logs(spark, folder)
    named = variants.null_fields(loose, "body", variants.fields_of(loose, "body"))
    timed = variants.with_variant_time(named, "body")
    return timed.select("event_id", "hour", "day_of_week", F.array_join("null_fields", ",").alias("nulls"))
