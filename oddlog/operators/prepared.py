"""Answers to single events: a model in one value, looked up and walked with native expressions.

A :class:`Prepared` model has the interface of :class:`oddlog.operators.detect.Scorer`, so :func:`detect` takes either.
Where a scorer joins ten lookups and walks trees in Arrow batches, which pays for large tables, this one carries the model
as a map from log type to slots, value maps and trees. It is a literal of the plan: there is no join, no Python worker
and no job but the one that reads the event, and the plan is a few projections over arrays, whatever the number of slots.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.names import c
from ..functions.scoring import average_path, deviation_level, rarity, rarity_level, z_score
from ..session import BROADCAST_BYTES
from ..sources.models import Model
from . import encode
from .forest import anomaly_score, pack
from .profile import as_number, as_text

VALUE_ROWS = 500_000  # lookup rows that a prepared model may hold
NODE_ROWS = 1_000_000  # tree nodes, about 24 MB

SLOT = {
    "feature": pa.string(),
    "source": pa.int32(),
    "is_category": pa.bool_(),
    "type": pa.string(),
    "is_optimal": pa.bool_(),
    "mean": pa.float64(),
    "std": pa.float64(),
    "total": pa.int64(),
    "unknown_code": pa.int32(),
    "scale_mean": pa.float64(),
    "scale_std": pa.float64(),
    "fill_median": pa.float64(),
    "codes": pa.map_(pa.string(), pa.int32()),
    "counts": pa.map_(pa.string(), pa.int64()),
}
TREE = pa.struct([("feature", pa.list_(pa.int32())), ("threshold", pa.list_(pa.float64())), ("length", pa.list_(pa.float64()))])
FACTS = pa.struct(
    [
        ("training_samples", pa.int64()),
        ("psi", pa.int32()),
        ("normal", pa.float64()),
        ("offset", pa.float64()),
        ("depth", pa.int32()),
        ("features_used", pa.list_(pa.string())),
        ("slots", pa.list_(pa.struct(list(SLOT.items())))),
        ("trees", pa.list_(TREE)),
    ]
)


class Prepared:
    """The models of ``log_types`` (all, if not given) as one value.

    The tables are read back to the driver once, after a check of their size: a larger set of models is refused, as it
    belongs to a :class:`Scorer`, or to several prepared ones with fewer log types each.
    """

    def __init__(self, model: Model, log_types: list[str] | None = None):
        tables = {name: getattr(model, name) for name in ("models", "features", "values", "forest")}
        if log_types is not None:
            tables = {name: df.where(F.col("log_type").isin(log_types)) for name, df in tables.items()}
        n, size = tables["values"].agg(F.count("*"), F.coalesce(F.sum(F.octet_length("value")), F.lit(0))).first()
        if n > VALUE_ROWS or size > BROADCAST_BYTES or tables["forest"].count() > NODE_ROWS:
            raise ValueError("too many values or tree nodes to prepare; use a Scorer or fewer log types")
        names = [n for n in SLOT if n not in ("source", "codes", "counts", "unknown_code")]
        slots = tables["features"].select("log_type", "slot", "optimal_rank", *names).collect()
        values = tables["values"].select("log_type", "slot", "value", "code", "cnt").collect()
        models = tables["models"].select("log_type", "training_samples", "psi", "offset").collect()
        self.log_types = sorted(r.log_type for r in models)
        self.fields = sorted({r.feature for r in slots})
        self.texts = {r.feature for r in slots if r.is_category or r.type == "categorical"}
        self.numbers = {r.feature for r in slots if not r.is_category or r.type == "numerical"}
        width = 1 + max((r.slot for r in slots), default=-1)
        trees = pack(tables["forest"].toPandas(), width)
        entries = [(r.log_type, self._facts(r, slots, values, trees.get(r.log_type))) for r in models]
        whole = pa.table({"model": pa.array([entries], pa.map_(pa.string(), FACTS))})
        self.shared = model.models.sparkSession.createDataFrame(whole)
        self.kept: dict[tuple, list[Column]] = {}

    def once(self, key: tuple, build: Callable[[], list[Column]]) -> list[Column]:
        """The columns of a step. They name what they need, so events of the same schema share them."""
        if key not in self.kept:
            self.kept[key] = build()
        return self.kept[key]

    def _facts(self, model, slots, values, packed) -> dict:
        found = []
        mine = sorted((r for r in slots if r.log_type == model.log_type), key=lambda r: r.slot)
        for r in mine:
            here = [v for v in values if v.log_type == model.log_type and v.slot == r.slot]
            codes = {v.value: v.code for v in here if v.code is not None}
            slot = {n: r[n] for n in SLOT if n in r.__fields__}
            slot |= {"source": self.fields.index(r.feature), "unknown_code": codes.get(encode.UNKNOWN)}
            found.append(slot | {"codes": list(codes.items()), "counts": [(v.value, v.cnt) for v in here]})
        used = sorted((r for r in mine if r.is_optimal), key=lambda r: (r.optimal_rank, r.feature))
        facts = {n: model[n] for n in ("training_samples", "psi", "offset")}
        facts |= {"slots": found, "features_used": [r.feature for r in used], "normal": average_path(model.psi), "depth": 0, "trees": []}
        if packed:
            feature, threshold, length, facts["depth"] = packed
            facts["trees"] = [{"feature": f.astype(np.int32), "threshold": t, "length": n} for f, t, n in zip(feature, threshold, length)]
        return facts

    def facts(self) -> Column:
        """What the row's log type has in the shared value; null where there is no such model."""
        return F.element_at(self.shared.scalar(), F.coalesce(c("log_type"), F.lit("")))

    def encode(self, df: DataFrame, keep: list[str] | None = None, fill: str = "zero", how: str = "left") -> DataFrame:
        """``keep``, the log type, the model's facts, and per slot its raw value, code, count and matrix value ``x``."""
        keys = [c(k) for k in keep or []]
        seen = (df.schema.json(), tuple(keep or ()))
        raw = self.once(("raw", *seen), lambda: [*keys, c("log_type"), *self._raw(df), self.facts().alias("_facts")])
        if how == "inner":
            df = df.where(c("log_type").isin(self.log_types))
        return df.select(*raw).select(*self.once(("slots", fill, *seen), lambda: [*keys, *self._slots(df, fill)]))

    def _raw(self, df: DataFrame) -> list[Column]:
        have = set(df.columns)

        def values(wanted: set[str], form, kind: str) -> Column:
            found = [form(df, f).cast(kind) if f in wanted & have else F.lit(None).cast(kind) for f in self.fields]
            return F.array(*found) if found else F.array().cast(f"array<{kind}>")

        texts, numbers = values(self.texts, as_text, "string"), values(self.numbers, as_number, "double")
        present = values(have, lambda d, f: c(f).isNotNull(), "boolean")
        return [texts.alias("_texts"), numbers.alias("_numbers"), present.alias("_present")]

    def _slots(self, df: DataFrame, fill: str) -> list[Column]:
        known = F.array(F.lit(False), *(F.lit(f in df.columns) for f in self.fields))

        def measured(s: Column) -> Column:
            category = s["is_category"]
            text = F.when(category | (s["type"] == "categorical"), F.get("_texts", s["source"]))
            number = F.when(~category | (s["type"] == "numerical"), F.get("_numbers", s["source"]))
            key = F.coalesce(text, F.lit(encode.UNKNOWN))
            gap = s["fill_median"] if fill == "median" else F.lit(0.0)
            scaled = encode.scale(encode.impute(number, gap), s["scale_mean"], s["scale_std"])
            code = F.when(F.get(known, s["source"] + 1), encode.label_code(F.element_at(s["codes"], key), s["unknown_code"])).otherwise(0)
            return F.struct(
                *(s[n].alias(n) for n in ("feature", "type", "is_optimal", "mean", "std", "total")),
                text.alias("text"),
                number.alias("number"),
                F.coalesce(F.get("_present", s["source"]), F.lit(False)).alias("present"),
                F.when(category | (s["type"] == "categorical"), F.element_at(s["counts"], key)).alias("cnt"),
                F.when(category, code.cast("double")).otherwise(F.coalesce(scaled, F.lit(0.0))).alias("x"),
            )

        facts = F.col("_facts")
        names = ("training_samples", "psi", "normal", "offset", "features_used")
        return [c("log_type"), *(facts[n].alias(n) for n in names), F.transform(facts["slots"], measured).alias("_slots")]

    def score(self, encoded: DataFrame) -> DataFrame:
        """Add ``score``, and with it ``feature_deviations`` and ``s_feature``, which saves a step of planning."""
        first = self.once(("trees",), lambda: [self.facts()["trees"], self.facts()["depth"], self._deviations(), F.transform("_slots", lambda s: s["feature"])])
        (score,) = self.once(("score",), lambda: [self._score()])
        return encoded.withColumns(dict(zip(("_trees", "depth", "feature_deviations", "s_feature"), first))).withColumn("score", score)

    def _score(self) -> Column:
        """The trees walked level by level, their path lengths summed in order.

        The row's matrix values travel with the sum, so they are worked out once and not once a node.
        """

        def step(node: Column, tree: Column, x: Column) -> Column:
            right = F.get(x, F.get(tree["feature"], node)) > F.get(tree["threshold"], node)
            return 2 * node + F.when(right, 1).otherwise(0)

        def walked(so_far: Column, tree: Column) -> Column:
            leaf = F.aggregate(so_far["levels"], F.lit(1), lambda node, _: step(node, tree, so_far["x"]))
            total = so_far["total"] + F.get(tree["length"], leaf)
            return F.struct(so_far["x"].alias("x"), so_far["levels"].alias("levels"), total.alias("total"), (so_far["n"] + 1).alias("n"))

        depth = F.col("depth")
        levels = F.when(depth > 0, F.sequence(F.lit(1), depth)).otherwise(F.array().cast("array<int>"))
        x = F.transform("_slots", lambda s: s["x"])
        start = F.struct(x.alias("x"), levels.alias("levels"), F.lit(0.0).alias("total"), F.lit(0).alias("n"))
        path = F.aggregate("_trees", start, walked, lambda end: F.when(end["n"] > 0, end["total"] / end["n"]))
        score = anomaly_score(path, F.when(F.col("normal") > 0, F.col("normal")).otherwise(1.0))
        return score

    def with_deviations(self, scored: DataFrame) -> DataFrame:
        """``scored`` as it is: scoring has added the deviations."""
        return scored

    def _deviations(self) -> Column:

        def entry(s: Column, z: Column, rare: Column) -> Column:
            return F.struct(
                s["feature"].alias("feature"),
                s["type"].alias("type"),
                F.when(z.isNotNull(), s["number"].cast("string")).otherwise(s["text"]).alias("value"),
                F.when(z.isNotNull(), s["mean"]).alias("mean"),
                F.when(z.isNotNull(), s["std"]).alias("std"),
                z.alias("z_score"),
                F.when(z.isNull(), F.coalesce(s["cnt"], F.lit(0))).alias("frequency"),
                F.when(z.isNull(), s["total"]).alias("total_samples"),
                rare.alias("rarity_score"),
                F.when(z.isNotNull(), deviation_level(z)).otherwise(rarity_level(rare)).alias("deviation_level"),
            )

        def measures(s: Column) -> Column:
            optimal = F.coalesce(s["is_optimal"], F.lit(False))
            numerical = optimal & (s["type"] == "numerical") & s["number"].isNotNull()
            category = optimal & (s["type"] == "categorical") & s["text"].isNotNull()
            z = F.when(numerical, z_score(s["number"], s["mean"], s["std"]))
            return F.struct(s.alias("s"), z.alias("z"), F.when(category, rarity(s["cnt"], s["total"])).alias("rare"))

        found = F.filter(F.transform("_slots", measures), lambda m: m["z"].isNotNull() | m["rare"].isNotNull())
        return F.transform(found, lambda m: entry(m["s"], m["z"], m["rare"]))

    def found_in_event(self) -> Column:
        """How many of the used features hold a value in the event."""
        return F.size(F.filter("_slots", lambda s: F.coalesce(s["is_optimal"], F.lit(False)) & s["present"]))

    def events(self, rows: list[dict], schema: T.StructType) -> DataFrame:
        """A few events, held by the caller, as a table that is read where the plan is: in one task, without a file."""
        return self.shared.sparkSession.createDataFrame(pa.Table.from_pylist(rows, to_arrow_schema(schema)), schema)
