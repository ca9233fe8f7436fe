"""Nested logs to flat columns, planned from the schema: the result is one static projection."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import timefeat
from ..functions.names import FIELD_ALIASES, TIME_FIELDS_TRAINING, c, is_internal_name

MAX_ITEMS = 5  # fixed value: objects kept per array


def _leaves(name: str, col: Column, dtype: T.DataType, max_items: int) -> Iterator[tuple[str, Column]]:
    if isinstance(dtype, T.StructType):
        for field in dtype.fields:
            yield from _leaves(f"{name}.{field.name}", col.getField(field.name), field.dataType, max_items)
    elif isinstance(dtype, T.ArrayType) and isinstance(dtype.elementType, T.StructType):
        for i in range(max_items):
            yield from _leaves(f"{name}[{i}]", F.get(col, i), dtype.elementType, max_items)
    elif isinstance(dtype, T.ArrayType):
        yield f"{name}_count", F.when(col.isNotNull(), F.size(col))
        first = F.get(col, 0)
        if isinstance(dtype.elementType, T.BooleanType):
            first = F.initcap(first.cast("string"))
        yield f"{name}_first", first.cast("string")
    elif isinstance(dtype, T.VariantType):
        yield name, F.to_json(col)
    else:
        yield name, col


def flatten(df: DataFrame, max_items: int = MAX_ITEMS) -> DataFrame:
    """Flat columns named by their path.

    Objects become ``parent.child``; arrays of scalars become ``x_count`` and ``x_first``; of arrays of objects the
    first ``max_items`` become ``x[i].child``. Should two paths spell the same name, the later one wins.
    """
    leaves: dict[str, Column] = {}
    for field in df.schema.fields:
        leaves.update(_leaves(field.name, c(field.name), field.dataType, max_items))
    return df.select(*[col.alias(name) for name, col in leaves.items()])


def json_schema(df: DataFrame, column: str) -> T.StructType:
    """Union schema of a JSON text column over all rows, from one distributed aggregate of schemas."""
    ddl = df.select(F.schema_of_variant_agg(F.try_parse_json(c(column)))).first()[0]
    ddl = (ddl or "VOID").replace("OBJECT<>", "STRUCT<>").replace("OBJECT<", "STRUCT<")
    parsed = T.DataType.fromDDL(f"j {ddl}").fields[0].dataType
    plain = _plain_types(parsed)
    return plain if isinstance(plain, T.StructType) else T.StructType([])


def _plain_types(dtype: T.DataType) -> T.DataType:
    """JSON kinds only: decimals are doubles; nulls and mixed kinds are text."""
    if isinstance(dtype, T.StructType):
        return T.StructType([T.StructField(f.name, _plain_types(f.dataType)) for f in dtype.fields])
    if isinstance(dtype, T.ArrayType):
        return T.ArrayType(_plain_types(dtype.elementType))
    if isinstance(dtype, T.DecimalType):
        return T.DoubleType()
    if isinstance(dtype, (T.NullType, T.VariantType)):
        return T.StringType()
    return dtype


def parse_json(df: DataFrame, column: str, schema: T.StructType | None = None) -> DataFrame:
    """Replace a JSON text column by its parsed struct; unparseable text gives nulls."""
    schema = schema or json_schema(df, column)
    return df.withColumn(column, F.from_json(c(column), schema) if schema.fields else F.lit(None).cast("string"))


def normalise_names(df: DataFrame, aliases: dict[str, str] = FIELD_ALIASES) -> DataFrame:
    """Rename lower-case field names to the spelling used in training.

    When an event carries both spellings the canonical one is used and the alias fills its gaps.
    """
    names = df.columns
    if not any(aliases.get(name, name) != name for name in names):
        return df
    # columns are taken by position: two spellings are one name to a session that ignores case
    numbered = df.toDF(*[f"_field_{i}" for i in range(len(names))])
    at = {name: F.col(f"_field_{i}") for i, name in enumerate(names)}
    out = []
    for name in names:
        target = aliases.get(name, name)
        if target != name and target in at:
            continue
        spare = [at[a] for a, t in aliases.items() if t == target and a in at and a != name]
        out.append((F.coalesce(at[name], *spare) if spare else at[name]).alias(target))
    return numbered.select(*out)


def drop_internal(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Drop the platform's own columns, except the event time; works on flat names."""
    return df.select(*[c(n) for n in df.columns if n in keep or not is_internal_name(n)])


def exclude(df: DataFrame, *names: str) -> DataFrame:
    """``SELECT * EXCLUDE``: all columns but the named ones; absent names are ignored."""
    return df.select(*[c(n) for n in df.columns if n not in names])


def project_fill(df: DataFrame, features: list[str], fill=0) -> DataFrame:
    """Exactly ``features`` in order; a column the data lacks is filled with ``fill``."""
    present = set(df.columns)
    return df.select(*[c(f) if f in present else F.lit(fill).alias(f) for f in features])


def time_source(df: DataFrame, fields: tuple[str, ...] = TIME_FIELDS_TRAINING) -> Column | None:
    """First present time field as a column (of text, when the fields' types differ)."""
    found = [f for f in fields if f in df.columns]
    if not found:
        return None
    types = {df.schema[f].dataType for f in found}
    if len(types) == 1:
        return timefeat.first_present([c(f) for f in found])
    return timefeat.first_present([c(f).cast("string") for f in found])


def with_time_features(df: DataFrame, fields: tuple[str, ...] = TIME_FIELDS_TRAINING) -> DataFrame:
    """Add ``hour`` and ``day_of_week`` from the first present time field; no such field, no features."""
    source = time_source(df, fields)
    if source is None:
        return df
    types = {df.schema[f].dataType for f in fields if f in df.columns}
    dtype = types.pop() if len(types) == 1 else T.StringType()
    return df.withColumns({"hour": timefeat.hour(source, dtype), "day_of_week": timefeat.day_of_week(source, dtype)})


def prepare(df: DataFrame) -> DataFrame:
    """The common front of training and detection: flatten, unify names, add time features."""
    return with_time_features(normalise_names(flatten(df)))


def present_fields(df: DataFrame, features: list[str]) -> Column:
    """Array of those ``features`` that hold a value in the row."""
    present = set(df.columns)
    named = [F.when(c(f).isNotNull(), F.lit(f)) for f in features if f in present]
    return F.array_compact(F.array(*named)) if named else F.array().cast("array<string>")


def presence_counts(df: DataFrame, features: list[str]) -> DataFrame:
    """Add ``features_found`` and ``features_missing``."""
    found = F.size(present_fields(df, features))
    return df.withColumns({"features_found": found, "features_missing": F.lit(len(features)) - found})


def field_set_diff(df: DataFrame, model_features: list[str]) -> DataFrame:
    """Add the field sets common to row and model, missing in the row, and unknown to the model."""
    in_row = present_fields(df, df.columns)
    in_model = F.array(*[F.lit(f) for f in model_features])
    return df.withColumns(
        {
            "common_fields": F.array_intersect(in_model, in_row),
            "missing_in_event": F.array_except(in_model, in_row),
            "missing_in_model": F.array_except(in_row, in_model),
        }
    )


def record_size(df: DataFrame) -> Column:
    """UTF-8 length of the row as JSON."""
    return F.octet_length(F.to_json(F.struct(*[c(n) for n in df.columns])))
