"""Flattening of logs without a fixed schema: JSON texts as VARIANT values, where a stated null is not an absent field.

``fields_of`` finds every path that occurs, with what stands there, by opening objects level by level; paths may be an object
in one row and a number in another, and both are kept, as ``user.name`` and ``user``. ``flatten_variant`` then is one static
projection by the naming rules of ``flatten``: ``parent.child``, ``x_count`` and ``x_first`` for arrays whose first item is no
object, ``x[i].child`` for the first ``max_items`` objects of the others. A column is bigint, double or boolean if nothing else
but nulls was found in it, and text otherwise.

Texts that hold no JSON object have no fields. A path that is null wherever it occurs is a text column of nulls. Of fields
whose paths spell one name, the one whose path sorts first is used, and gaps are filled from the others.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import timefeat
from ..functions.names import TIME_FIELDS_TRAINING, c
from ..session import stage
from .flatten import MAX_ITEMS

VALUE = "_variant"
NULL, OBJECT, ARRAY = "VOID", "OBJECT", "ARRAY"
NUMBERS = {"BIGINT", "DECIMAL", "DOUBLE"}


def as_object(text: Column) -> Column:
    """The parsed object; anything else is null."""
    value = F.try_parse_json(text)
    return F.when(kind_of(value) == OBJECT, value)


def kind_of(value: Column) -> Column:
    """VOID for a stated null, SQL null for an absent field; else OBJECT, ARRAY or the name of the scalar type."""
    return F.regexp_extract(F.schema_of_variant(value), r"^\w+", 0)


def step(value: Column, at: str | int) -> Column:
    """The child called ``at`` of an object, or the item at this place of an array, as a variant; absent gives SQL null."""
    if isinstance(at, int):
        return F.try_variant_get(value, f"$[{at}]", "variant")
    if at and '"' not in at and "?" not in at:
        return F.try_variant_get(value, f'$["{at}"]', "variant")
    children = F.try_variant_get(value, "$", "map<string,variant>")  # names that a path cannot spell
    return F.try_element_at(children, F.lit(at))


@dataclass(frozen=True)
class Field:
    """One path with the kinds found there."""

    name: str
    path: tuple
    kinds: frozenset

    def value(self, root: Column) -> Column:
        for at in self.path:
            root = step(root, at)
        return root

    def columns(self, root: Column) -> dict[str, Column]:
        value, out = self.value(root), {}
        if ARRAY in self.kinds:
            items = F.when(kind_of(value) == ARRAY, F.try_variant_get(value, "$", "array<variant>"))
            first = F.get(items, 0)
            items = F.when(~F.coalesce(kind_of(first) == OBJECT, F.lit(False)), items)
            text = F.try_variant_get(first, "$", "string")
            out[f"{self.name}_count"] = F.when(items.isNotNull(), F.size(items))
            out[f"{self.name}_first"] = F.when(
                items.isNotNull(), F.when(kind_of(first) == "BOOLEAN", F.initcap(text)).otherwise(text)
            )
        scalars = self.kinds - {NULL, OBJECT, ARRAY}
        if scalars or not self.kinds - {NULL}:
            dtype = "string"
            if scalars and scalars <= NUMBERS:
                dtype = "bigint" if scalars == {"BIGINT"} else "double"
            elif scalars == {"BOOLEAN"}:
                dtype = "boolean"
            col = F.try_variant_get(value, "$", dtype)
            if self.kinds & {OBJECT, ARRAY}:
                col = F.when(~kind_of(value).isin(OBJECT, ARRAY), col)
            out[self.name] = col
        return out


def _opened(level: DataFrame, max_items: int) -> DataFrame:
    """(path, name, kind, value) of all children of the objects in ``level``; of arrays of objects also their first items."""
    children = level.lateralJoin(level.sparkSession.tvf.variant_explode(F.col("value").outer()).toDF("pos", "key", "child"))
    name = F.when(F.col("name") == "", F.col("key")).otherwise(F.concat("name", F.lit("."), "key"))
    path = F.concat("path", F.array(F.to_json(F.struct(F.col("key").alias("k")))))
    children = children.select(path.alias("path"), name.alias("name"), F.col("child").alias("value"))
    children = children.withColumn("kind", kind_of(F.col("value")))
    items = F.when(F.col("kind") == ARRAY, F.try_variant_get("value", "$", "array<variant>"))
    items = F.when(kind_of(F.get(items, 0)) == OBJECT, F.slice(items, 1, max_items))
    single = F.struct("path", "name", "value", "kind")

    def inner(item: Column, i: Column) -> Column:
        return F.struct(
            F.concat("path", F.array(F.format_string('{"i":%d}', i))).alias("path"),
            F.format_string("%s[%d]", "name", i).alias("name"),
            item.alias("value"),
            kind_of(item).alias("kind"),
        )

    # an array of objects is no field of its own, its items are
    entries = F.when(items.isNull(), F.array(single)).otherwise(F.transform(items, inner))
    return children.select(F.inline(entries))


def fields_of(df: DataFrame, column: str, max_items: int = MAX_ITEMS) -> list[Field]:
    """All fields of the JSON texts in ``column``, sorted by name.

    Every row is read, twice; below that, only the nested objects of a level, which are written for the next one. What
    comes to the driver is one row per path and kind.
    """
    root = df.select(F.array().cast("array<string>").alias("path"), F.lit("").alias("name"), as_object(c(column)).alias("value"))
    level, found = root.where("value IS NOT NULL"), {}
    while True:
        opened = _opened(level, max_items)
        seen = opened.groupBy("path", "name", "kind").agg(F.count(F.lit(1)).alias("n")).collect()
        for row in seen:
            found.setdefault((row.name, tuple(row.path)), set()).add(row.kind)
        if not any(row.kind == OBJECT for row in seen):
            break
        level = stage(opened.where(F.col("kind") == OBJECT).select("path", "name", "value"), "variant-level")
    out = []
    for (name, path), kinds in sorted(found.items()):
        steps = tuple(next(iter(json.loads(s).values())) for s in path)
        if kinds - {OBJECT} and not (isinstance(steps[-1], int) and kinds == {NULL, OBJECT}):
            out.append(Field(name, steps, frozenset(kinds)))
    return out


def with_value(df: DataFrame, column: str) -> DataFrame:
    """Parse once: all fields are taken from one column."""
    return df.withColumn(VALUE, as_object(c(column)))


def flatten_variant(df: DataFrame, column: str, fields: list[Field] | None = None, max_items: int = MAX_ITEMS) -> DataFrame:
    """Replace the JSON texts in ``column`` by their flat columns; other columns stay and win over fields of their name."""
    fields = fields_of(df, column, max_items) if fields is None else fields
    flat: dict[str, list[Column]] = {}
    for field in fields:
        for name, col in field.columns(F.col(VALUE)).items():
            flat.setdefault(name, []).append(col)
    kept = [n for n in df.columns if n != column]
    out = []
    for name, cols in flat.items():
        if name not in kept:
            out.append((cols[0] if len(cols) == 1 else F.coalesce(*[col.cast("string") for col in cols])).alias(name))
    return with_value(df, column).select(*[c(n) for n in kept], *out)


def null_fields(df: DataFrame, column: str, fields: list[Field], name: str = "null_fields") -> DataFrame:
    """Add the names of fields that a row states as null, as opposed to those that it lacks."""
    stated = [F.when(F.is_variant_null(f.value(F.col(VALUE))), F.lit(f.name)) for f in fields if NULL in f.kinds]
    found = F.array_compact(F.array(*stated)) if stated else F.array().cast("array<string>")
    return with_value(df, column).withColumn(name, found).drop(VALUE)


def with_variant_time(df: DataFrame, column: str, times: tuple[str, ...] = TIME_FIELDS_TRAINING) -> DataFrame:
    """Add ``hour`` and ``day_of_week`` from the first time field that a row states.

    A stated null, a number and a text that is no time give -1; no time field at all and an empty text give null.
    """
    chosen = F.coalesce(*[step(F.col(VALUE), t) for t in times])
    text = F.when(kind_of(F.col("_time")) == "STRING", F.try_variant_get("_time", "$", "string"))
    unread = F.col("_time").isNotNull() & text.isNull()
    parsed = with_value(df, column).withColumn("_time", chosen)
    for name, feature in (("hour", timefeat.hour), ("day_of_week", timefeat.day_of_week)):
        parsed = parsed.withColumn(name, F.when(unread, F.lit(-1)).otherwise(feature(text)))
    return parsed.drop(VALUE, "_time")
