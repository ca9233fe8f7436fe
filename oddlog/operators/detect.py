"""Scoring and explaining events; map-only, so it runs unchanged on batches and streams."""

from __future__ import annotations

from functools import cached_property

from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.names import c
from ..functions.scoring import (
    DEFAULT_THRESHOLD,
    average_path,
    deviation_level,
    explanation,
    notable_text,
    rarity,
    rarity_level,
    z_score,
)
from ..session import BROADCAST_ROWS, fits
from ..sources.models import Model
from . import encode
from .flatten import flatten, normalise_names, with_time_features
from .forest import anomaly_score, path_lengths, share_forest
from .prepared import Prepared
from .requests import BAD_JSON, read_requests
from .route import missing_model, route

FOREST_ROWS = 2_000_000  # node rows broadcast at a time, about 50 MB packed; more log types are scored in turns
CORRUPT = "_corrupt_record"
DEVIATION = (
    "struct<feature:string,type:string,value:string,mean:double,std:double,z_score:double,frequency:bigint,"
    "total_samples:bigint,rarity_score:double,deviation_level:string>"
)


class Scorer:
    """A model made ready for scoring: slot plans on the driver, tables checked for broadcast, forests shared.

    What is read back here is one row per (log type, slot), at most ten slots each, and the trees in checked portions.
    Afterwards scoring is planned without a job.
    """

    def __init__(self, model: Model):
        self.model = model
        rows = model.features.select(
            "log_type", "slot", "feature", "is_category", "type", "is_optimal", "optimal_rank"
        ).collect()
        self.slots = 1 + max((r.slot for r in rows), default=-1)
        self.rows = rows
        models = model.models.select("log_type", "psi").collect()
        self.log_types = sorted(r.log_type for r in models)
        self.psis = sorted({r.psi for r in models})
        self.small = fits(model.values, encode.LOOKUP_ROWS, encode.LOOKUP_BYTES)
        self.parameters = self._parameters()
        self.kept: dict[tuple, list[Column]] = {}

    def once(self, key: tuple, build) -> list[Column]:
        """The columns of a step, worked out at its first use."""
        if key not in self.kept:
            self.kept[key] = build()
        return self.kept[key]

    def plan(self, slot: int, where) -> list[tuple[str, str]]:
        return [(r.log_type, r.feature) for r in self.rows if r.slot == slot and where(r)]

    def _parameters(self) -> DataFrame:
        """One row per log type: slot-indexed arrays (at most ten entries) and model facts."""
        features = self.model.features.join(encode.unknown_codes(self.model.values), ["log_type", "slot"], "left")
        names = [
            "feature", "is_category", "type", "is_optimal", "mean", "std", "total",
            "unknown_code", "scale_mean", "scale_std", "fill_median",
        ]
        arrays = (
            features.groupBy("log_type")
            .agg(F.sort_array(F.collect_list(F.struct("slot", *names))).alias("s"))
            .select("log_type", *[F.col(f"s.{n}").alias(f"s_{n}") for n in names])
        )
        used = F.sort_array(F.collect_list(F.when(F.col("is_optimal"), F.struct("optimal_rank", "feature"))))
        optimal = features.groupBy("log_type").agg(F.transform(used, lambda e: e["feature"]).alias("features_used"))
        models = self.model.models.select("log_type", "training_samples", "psi", "offset")
        rows = models.join(arrays, "log_type").join(optimal, "log_type")
        return rows.sparkSession.createDataFrame(rows.collect(), rows.schema)

    def with_parameters(self, df: DataFrame, how: str) -> DataFrame:
        """Attach the parameters, one row per configured log type."""
        few = len(self.log_types) <= BROADCAST_ROWS
        return df.join(F.broadcast(self.parameters) if few else self.parameters, "log_type", how)

    def slot_values(self, df: DataFrame, keep: list[str]) -> DataFrame:
        """Only ``keep``, the log type and the slots' raw values: ``text_i``, ``number_i`` and whether they are there.

        All other fields are left behind here, so no field of an event can clash with a column added later.
        """
        columns = [c(k) for k in keep] + [c("log_type")]
        for i in range(self.slots):
            texts = self.plan(i, lambda r: r.is_category or r.type == "categorical")
            numbers = self.plan(i, lambda r: not r.is_category or r.type == "numerical")
            present = encode.slot_column(df, "log_type", self.plan(i, lambda r: True), lambda d, f: c(f).isNotNull())
            columns += [
                encode.text_slot(df, "log_type", texts).alias(f"text_{i}"),
                encode.number_slot(df, "log_type", numbers).alias(f"number_{i}"),
                F.coalesce(present.cast("boolean"), F.lit(False)).alias(f"present_{i}"),
            ]
        return df.select(*columns)

    def encode(self, df: DataFrame, keep: list[str] | None = None, fill: str = "zero", how: str = "left") -> DataFrame:
        """The model matrix ``x_0 .. x_n`` next to the slots' values, their codes and their training counts.

        ``fill`` is what a missing number becomes before scaling: ``zero`` or the training ``median``.
        """
        out = self.with_parameters(self.slot_values(df, keep or []), how)
        for i in range(self.slots):

            def at(name: str, i=i) -> Column:
                return F.get(f"s_{name}", F.lit(i))

            if self.plan(i, lambda r: r.is_category or r.type == "categorical"):
                key = F.coalesce(F.col(f"text_{i}"), F.lit(encode.UNKNOWN))
                out = encode.lookup(out, "log_type", key, self.model.values, i, self.small)
            else:
                out = out.withColumns(
                    {f"code_{i}": F.lit(None).cast("int"), f"cnt_{i}": F.lit(None).cast("bigint")}
                )
            # a feature the table has no column for is 0, one without a value in this row is the class "unknown"
            have = [t for t, f in self.plan(i, lambda r: r.is_category) if f in df.columns]
            code = F.when(
                c("log_type").isin(have), encode.label_code(F.col(f"code_{i}"), at("unknown_code"))
            ).otherwise(0) if have else F.lit(0)
            gap = at("fill_median") if fill == "median" else F.lit(0.0)
            scaled = encode.scale(encode.impute(F.col(f"number_{i}"), gap), at("scale_mean"), at("scale_std"))
            out = out.withColumn(
                f"x_{i}", F.when(at("is_category"), code.cast("double")).otherwise(F.coalesce(scaled, F.lit(0.0)))
            )
        return out

    @property
    def matrix(self) -> list[str]:
        return [f"x_{i}" for i in range(self.slots)]

    @cached_property
    def forests(self) -> list[tuple[list[str], Broadcast]]:
        """Sets of log types whose trees fit one broadcast, each shared once, at the first scoring."""
        if not self.matrix:
            return []
        counts = {r[0]: r[1] for r in self.model.forest.groupBy("log_type").count().collect()}
        sets: list[list[str]] = [[]]
        room = FOREST_ROWS
        for log_type in self.log_types:
            if sets[-1] and counts.get(log_type, 0) > room:
                sets.append([])
                room = FOREST_ROWS
            sets[-1].append(log_type)
            room -= counts.get(log_type, 0)
        trees = self.model.forest
        parts = [trees] if len(sets) == 1 else [trees.where(F.col("log_type").isin(group)) for group in sets]
        return [(group, share_forest(part, self.slots)) for group, part in zip(sets, parts)]

    def score(self, encoded: DataFrame) -> DataFrame:
        """Add ``score``; forests too many to broadcast at once are applied one set of log types at a time."""
        if not self.forests:
            return encoded.withColumn("score", F.lit(None).cast("double"))
        if len(self.forests) == 1:
            return self._with_score(encoded, path_lengths(self.forests[0][1], self.matrix))
        rest = encoded.where(c("log_type").isNull() | ~c("log_type").isin(self.log_types))
        out = rest.withColumn("score", F.lit(None).cast("double"))
        for group, packed in self.forests:
            part = encoded.where(c("log_type").isin(group))
            out = out.unionByName(self._with_score(part, path_lengths(packed, self.matrix)))
        return out

    def _with_score(self, df: DataFrame, path: Column) -> DataFrame:
        normal = F.lit(None).cast("double")
        for psi in self.psis:
            normal = F.when(F.col("psi") == psi, F.lit(average_path(psi))).otherwise(normal)
        return df.withColumn("score", anomaly_score(path, F.when(normal > 0, normal).otherwise(1.0)))

    def with_deviations(self, encoded: DataFrame) -> DataFrame:
        """Add ``feature_deviations``: the features detection uses and the event holds, in model order.

        The measures are columns of their own, so each is computed once however often the array refers to it.
        """
        measures, entries = {}, []
        for i in range(self.slots):

            def at(name: str, i=i) -> Column:
                return F.get(f"s_{name}", F.lit(i))

            number, text, count = F.col(f"number_{i}"), F.col(f"text_{i}"), F.col(f"cnt_{i}")
            numerical = F.coalesce(at("is_optimal"), F.lit(False)) & (at("type") == "numerical") & number.isNotNull()
            category = F.coalesce(at("is_optimal"), F.lit(False)) & (at("type") == "categorical") & text.isNotNull()
            measures[f"z_{i}"] = F.when(numerical, z_score(number, at("mean"), at("std")))
            measures[f"rare_{i}"] = F.when(category, rarity(count, at("total")))
            z, rare = F.col(f"z_{i}"), F.col(f"rare_{i}")
            is_number = z.isNotNull()
            entries.append(
                F.when(
                    is_number | rare.isNotNull(),
                    F.struct(
                        at("feature").alias("feature"),
                        at("type").alias("type"),
                        F.when(is_number, number.cast("string")).otherwise(text).alias("value"),
                        F.when(is_number, at("mean")).alias("mean"),
                        F.when(is_number, at("std")).alias("std"),
                        z.alias("z_score"),
                        F.when(~is_number, F.coalesce(count, F.lit(0))).alias("frequency"),
                        F.when(~is_number, at("total")).alias("total_samples"),
                        rare.alias("rarity_score"),
                        F.when(is_number, deviation_level(z)).otherwise(rarity_level(rare)).alias("deviation_level"),
                    ),
                )
            )
        array = F.array_compact(F.array(*entries)) if entries else F.array().cast(f"array<{DEVIATION}>")
        return encoded.withColumns(measures).withColumn("feature_deviations", array)

    def found_in_event(self) -> Column:
        """How many of the used features hold a value in the event."""
        total = F.lit(0)
        for i in range(self.slots):
            total = total + F.when(F.get("s_is_optimal", F.lit(i)) & F.col(f"present_{i}"), 1).otherwise(0)
        return total


def results(scorer: Scorer | Prepared, scored: DataFrame, threshold: Column, keep: list[str]) -> DataFrame:
    """Assemble the result row from a scored, encoded table."""
    margin = F.col("score") - F.col("offset")
    decided = {"anomaly_score": margin, "anomaly_threshold": threshold, "is_anomaly": margin < threshold}
    out = scorer.with_deviations(scored).withColumns(decided)
    notable, *columns = scorer.once(("results", *keep), lambda: result_columns(scorer, keep))
    return out.withColumn("notable", notable).select(*columns)


def result_columns(scorer: Scorer | Prepared, keep: list[str]) -> list[Column]:
    """The text of the notable features, then the columns of a result row."""
    count = F.size("s_feature")
    used = F.size("features_used")
    info = F.struct(
        F.col("training_samples"),
        count.alias("total_features_available"),
        F.col("features_used").alias("features_actually_used"),
        used.alias("features_used_count"),
        scorer.found_in_event().alias("features_found_in_event"),
        (used - scorer.found_in_event()).alias("features_missing_from_event"),
    )
    known = F.col("psi").isNotNull()
    sentence = explanation(
        F.col("feature_deviations"), F.col("notable"), F.col("anomaly_score"), F.col("is_anomaly")
    )
    return [
        notable_text(F.col("feature_deviations"), F.col("is_anomaly")),
        *[c(k) for k in keep],
        F.col("log_type"),
        F.col("is_anomaly"),
        F.col("anomaly_score"),
        F.when(known, F.col("anomaly_threshold")).alias("anomaly_threshold"),
        F.when(known, sentence).alias("explanation"),
        F.when(known, F.col("feature_deviations")).alias("feature_deviations"),
        F.when(known, info).alias("model_info"),
        F.when(~known, missing_model(F.col("log_type"))).alias("error"),
    ]


def detect(
    events: DataFrame,
    model: Model | Scorer | Prepared,
    threshold: float | Column = DEFAULT_THRESHOLD,
    explicit: str | None = None,
    keep: tuple[str, ...] = (),
    fill: str = "zero",
    corrupt: str | None = CORRUPT,
    **routing,
) -> DataFrame:
    """Score every event: one result row each, with an error text where no model fits or the text was no JSON.

    ``corrupt`` names the column in which a JSON reader leaves text that it could not parse, if there is one.
    ``model`` may be a :class:`Scorer`, for tables, or a :class:`oddlog.operators.prepared.Prepared`, for single events.
    ``explicit`` names a column with the log type given by the caller, ``threshold`` a number or a column (a missing
    value means the default), ``keep`` the identifying columns to carry into the result.
    """
    scorer = Scorer(model) if isinstance(model, Model) else model
    broken = corrupt is not None and corrupt in events.columns
    kept, keep = keep, (*keep, corrupt) if broken else keep
    carried = {f"_keep_{k}": c(k) for k in dict.fromkeys([*keep, *([explicit] if explicit else [])])}
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    tagged = events.withColumns({**carried, "_threshold": F.coalesce(limit.cast("double"), F.lit(DEFAULT_THRESHOLD))})
    flat = flatten(tagged)
    routed = flat.withColumn(
        "log_type", route(flat, scorer.log_types, f"_keep_{explicit}" if explicit else None, **routing)
    )
    ready = with_time_features(normalise_names(routed))
    held = [f"_keep_{k}" for k in keep]
    scored = scorer.score(scorer.encode(ready, [*held, "_threshold"], fill))
    out = results(scorer, scored, F.col("_threshold"), held)
    if broken:
        text = F.col(f"_keep_{corrupt}")
        out = out.withColumn("error", F.when(text.isNotNull(), BAD_JSON).otherwise(F.col("error"))).drop(f"_keep_{corrupt}")
    return out.withColumnsRenamed({f"_keep_{k}": k for k in kept if k not in out.columns})


def score_requests(
    requests: DataFrame, body: str, event_schema: T.StructType, model: Model | Scorer | Prepared, keep: tuple[str, ...] = (), **routing
) -> DataFrame:
    """Answer every request: checked, routed, scored and explained, or kept with what is wrong with it.

    ``body`` holds the request text. One pass without a shuffle; bad requests are not told apart before the end.
    """
    asked = read_requests(requests.select(*[c(k) for k in keep], c(body)), body, event_schema)
    own = {f"_request_{k}": c(k) for k in keep}
    events = asked.select(
        *[column.alias(name) for name, column in own.items()],
        F.col("error").alias("_request_error"),
        F.col("log_type").alias("_request_type"),
        F.col("anomaly_threshold").alias("_request_limit"),
        "event_data.*",
    )
    found = detect(
        events, model, F.col("_request_limit"), "_request_type", (*own, "_request_error"), **routing
    )
    answered = found.withColumn("error", F.coalesce("_request_error", "error")).drop("_request_error")
    return answered.withColumnsRenamed({f"_request_{k}": k for k in keep})


def alerts(results: DataFrame) -> DataFrame:
    """Only the events to forward."""
    return results.where("is_anomaly")
