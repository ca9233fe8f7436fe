"""The training job: profile, select, encode, grow, calibrate; all log types in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.names import c
from ..operators import encode, forest as trees
from ..operators.detect import Scorer
from ..operators.flatten import drop_internal, prepare
from ..operators.profile import Profile, profile
from ..operators.select import TARGET, mark_optimal, select_features
from ..session import FILE_ROWS, join_side, spread, stage
from ..sources.models import Model

MIN_ROWS = 100  # fixed value: smaller log types are not trained
BY = ["log_type"]


def training_view(logs: DataFrame, log_type: str = "log_type", keep: tuple[str, ...] = ()) -> DataFrame:
    """Flat training columns of a log table that names its log type in a column; ``keep`` spares internal columns."""
    flat = prepare(logs.withColumn("_log_type", c(log_type).cast("string")).drop(log_type))
    return drop_internal(flat.withColumnRenamed("_log_type", "log_type"), keep)


def enough_rows(df: DataFrame, by: list[str], minimum: int = MIN_ROWS) -> DataFrame:
    """Rows of the groups that have at least ``minimum`` rows."""
    sizes = df.groupBy(*[c(k) for k in by]).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= minimum)
    return df.join(join_side(sizes.drop("n"), "large-groups"), by, "left_semi")


def model_features(found: Profile, target: int = TARGET) -> DataFrame:
    """The feature table of a model: chosen features in slots, with statistics and scaling."""
    eligible = found.features.where(F.col("rows") >= MIN_ROWS)
    selected = mark_optimal(select_features(eligible, BY, target), BY, target)
    return encode.fit_scalers(selected).drop("position", "ordinal", "min_coverage", "raw_mean", "raw_std_pop", "entropy_bits")


def fit(
    logs: DataFrame,
    log_type: str = "log_type",
    row_key: list[str] | None = None,
    target: int = TARGET,
    n_trees: int = trees.TREES,
    contamination: float = trees.CONTAMINATION,
    seed: int = trees.SEED,
    columns: list[str] | None = None,
) -> Model:
    """Train one isolation forest per log type. A log type that fails is named in ``failures`` and stops no other.

    The log table is read for the moments, for the sketches of columns that may be categories, and once more for the
    columns that can still become features. These are stored; value counts, quantiles, the draw and the scoring of
    the training rows for the offset read the stored columns, which lie in small files. A table that few tasks would
    read is stored so first, and read once. ``row_key`` names columns that identify an event, see
    :func:`oddlog.operators.forest.draw_samples`; they are never features themselves unless listed in ``columns``.
    """
    view = training_view(logs, log_type, tuple(row_key or ()))
    candidates = columns or [n for n in view.columns if n != "log_type" and n not in (row_key or [])]
    keys = [n for n in row_key or []]
    needed = {"log_type", *keys, *candidates}
    view = view.select(*[c(n) for n in view.columns if n in needed])
    whole = spread(view, "log")
    held: list[DataFrame] = []

    def hold(names: list[str]) -> DataFrame:
        narrow = whole.select("log_type", *[c(n) for n in dict.fromkeys([*keys, *names])])
        held.append(stage(narrow, "candidates", FILE_ROWS) if whole is view else narrow)
        return held[0]

    found = profile(whole, BY, columns=candidates, hold=hold)
    # small and used several times by the selection
    found = Profile(BY, stage(found.features, "profile"), found.counts)
    features = stage(model_features(found, target), "features")
    values = stage(encode.fit_values(features, found.counts, BY), "values")

    sizes = features.groupBy("log_type").agg(F.max("rows").alias("training_samples"), unscalable().alias("error"))
    measured = sizes.collect()
    rows = {r.log_type: r.training_samples for r in measured if not r.error}
    errors = [(r.log_type, r.error) for r in measured if r.error]  # as rows, at most one row per log type
    sizes = sizes.drop("error")
    lists = feature_names(features)
    psi = F.least(F.lit(trees.MAX_SAMPLES), F.col("training_samples")).cast("int")
    models = sizes.join(lists, "log_type").withColumn("psi", psi).withColumn("offset", F.lit(0.0))

    models, features, values = without(errors, models, features, values)
    if not rows:
        return untrained(models, features, values, errors)
    scorer = Scorer(Model(models, features, values, features))
    used = sorted({r.feature for r in scorer.rows})
    narrow = held[0].select("log_type", *[c(n) for n in dict.fromkeys([*keys, *used])])
    drawn = trees.draw_samples(narrow, rows, row_key, n_trees, seed)
    grown = stage(trees.fit_forest(scorer.encode(drawn, ["_tree"], "median", "inner"), scorer.matrix, seed), "forest")
    ungrown = grown.where("error IS NOT NULL").groupBy("log_type").agg(F.min("error").alias("error")).collect()
    if ungrown:
        errors += [(r.log_type, r.error) for r in ungrown]
        models, features, values, grown = without(errors, models, features, values, grown)
        if len(ungrown) == len(rows):
            return untrained(models, features, values, errors)
        scorer = Scorer(Model(models, features, values, features))
    grown = grown.drop("error")

    scorer.model = Model(models, features, values, grown)
    scores = stage(
        scorer.score(scorer.encode(narrow, [], "median", "inner")).select("log_type", "score"), "training-scores"
    )
    offsets = stage(trees.score_offsets(scores, contamination), "offsets")
    rates = trees.anomaly_rates(scores, offsets)
    params = {
        "n_estimators": n_trees, "max_samples": "auto", "contamination": contamination, "max_features": 1.0,
        "bootstrap": False, "random_state": seed,
    }
    models = (
        models.drop("offset")
        .join(offsets, "log_type")
        .join(rates, "log_type")
        .withColumn("params", F.create_map(*[F.lit(str(x)) for kv in params.items() for x in kv]))
    )
    return Model(stage(models, "models"), features, values, grown, failures(models.sparkSession, errors))


def unscalable() -> Column:
    """What is wrong with the chosen numbers of a log type: a column that holds an infinite number has no finite mean."""

    def odd(name: str) -> Column:
        return F.isnan(name) | F.col(name).isin(float("inf"), float("-inf"))

    bad = ~F.col("is_category") & (odd("scale_mean") | odd("scale_std"))
    return F.concat(F.min(F.when(bad, F.col("feature"))), F.lit(f": {trees.NOT_FINITE}"))


def without(errors: list[tuple[str, str]], *tables: DataFrame) -> list[DataFrame]:
    """The tables without the log types that failed."""
    gone = [log_type for log_type, _ in errors]
    return [df.where(~F.col("log_type").isin(gone)) if gone else df for df in tables]


def failures(spark: SparkSession, errors: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame(errors, "log_type string, error string")


def untrained(models: DataFrame, features: DataFrame, values: DataFrame, errors: list[tuple[str, str]]) -> Model:
    """The empty model of a log table none of whose log types can be trained."""
    forest = models.sparkSession.createDataFrame([], trees.FOREST_SCHEMA)
    empty = models.withColumns({"anomaly_rate": F.lit(None).cast("double"), "params": F.create_map().cast("map<string,string>")})
    return Model(empty, features, values, forest, failures(models.sparkSession, errors))


def feature_names(features: DataFrame) -> DataFrame:
    """Feature lists per log type in slot order."""

    def names(where):
        return F.transform(
            F.sort_array(F.collect_list(F.when(where, F.struct("slot", "feature")))), lambda e: e["feature"]
        )

    return features.groupBy("log_type").agg(
        names(F.col("is_category")).alias("categorical_features"),
        names(~F.col("is_category")).alias("numerical_features"),
    )


def training_report(logs: DataFrame, model: Model, log_type: str = "log_type", minimum: int = MIN_ROWS) -> DataFrame:
    """One row per log type: rows, feature counts, anomaly rate and status; untrained types say why."""
    sizes = logs.groupBy(c(log_type).cast("string").alias("log_type")).agg(F.count(F.lit(1)).alias("samples"))
    done = model.models.select(
        "log_type",
        F.size("categorical_features").cast("bigint").alias("n_categorical"),
        F.size("numerical_features").cast("bigint").alias("n_numerical"),
    )
    status = (
        F.when(F.col("n_categorical").isNotNull(), "SUCCESS")
        .when(F.col("samples") < minimum, "FAILED - insufficient data")
        .when(F.col("error").isNotNull(), F.concat(F.lit("FAILED - "), "error"))
        .otherwise("FAILED - no suitable features")
    )
    errors = failures(logs.sparkSession, []) if model.failures is None else model.failures
    return sizes.join(done, "log_type", "left").join(errors, "log_type", "left").withColumn("status", status).drop("error")


def validate_models(models: DataFrame, low: int = 4, high: int = 7) -> DataFrame:
    """Feature counts per model and whether their total lies in the accepted range."""
    n_cat = F.size("categorical_features").cast("bigint")
    n_num = F.size("numerical_features").cast("bigint")
    return models.select(
        "log_type",
        n_cat.alias("n_categorical"),
        n_num.alias("n_numerical"),
        (n_cat + n_num).alias("n_features"),
        F.col("training_samples"),
        (n_cat + n_num).between(low, high).alias("in_range"),
    )
