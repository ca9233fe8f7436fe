"""A trained model as four tables, and their versioned storage.

Every save writes a new version of the four tables. A manifest row per log type, written last, says which version holds,
and how many rows with which digest each table has. A crash on the way leaves the earlier version in force. Loading
compares the stored tables with the manifest and leaves out log types with a missing, incomplete or unreadable part.
"""

from __future__ import annotations

import logging
import time
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.names import c
from ..session import stage

LOG = logging.getLogger(__name__)

TABLES = {
    "models": "categorical_features array<string>, numerical_features array<string>, training_samples bigint, psi int,"
    " offset double, anomaly_rate double, params map<string,string>, log_type string",
    "features": "slot int, feature string, is_category boolean, type string, rows bigint, non_null bigint,"
    " mean double, std double, min double, max double, median double, q25 double, q75 double,"
    " unique_count bigint, total bigint, most_common string, most_common_freq bigint,"
    " coverage double, cardinality bigint, entropy double, score double, rank int, forced boolean,"
    " is_optimal boolean, optimal_rank int, scale_mean double, scale_std double, fill_median double,"
    " log_type string",
    "values": "slot int, feature string, value string, code int, cnt bigint, log_type string",
    "forest": "tree int, node int, feature int, threshold double, path_length double, node_rows int, log_type string",
}

MANIFEST = "log_type string, version string, tables map<string,struct<rows:bigint,digest:bigint>>"
LOADED, WITHOUT_FOREST = "loaded", "no forest"


@dataclass
class Model:
    """All log types' models.

    ``models``   one row per log type: feature lists, training rows, sample size, score offset, parameters
    ``features`` one row per (log type, slot): statistics, scaling and whether detection uses it
    ``values``   label codes and training counts of categorical values
    ``forest``   tree nodes
    ``failures`` (log_type, error) of log types that could not be trained; not stored
    """

    models: DataFrame
    features: DataFrame
    values: DataFrame
    forest: DataFrame
    failures: DataFrame | None = None

    def save(self, path: str) -> str:
        """Store a new version of the log types held here and put it in force; others stay. The version's name."""
        version = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        spark = self.models.sparkSession
        for name, schema in TABLES.items():
            table = getattr(self, name).to(T.StructType.fromDDL(schema))
            table.write.partitionBy("log_type").parquet(f"{path}/{name}/version={version}")
        held = _contents(spark, path, F.col("version") == version).drop("version")
        entries = F.map_from_entries(F.collect_list(F.struct("table", F.struct("rows", "digest"))))
        manifest = held.groupBy("log_type").agg(entries.alias("tables"))
        manifest.coalesce(1).write.parquet(f"{path}/manifest/version={version}")
        return version

    @staticmethod
    def load(spark: SparkSession, path: str) -> "Model":
        """The versions in force of all log types that are whole; the others are left out, with a warning each."""
        found = store_status(spark, path).collect()  # one row per log type
        for row in found:
            if row.status != LOADED:
                LOG.warning("model of %s left out: %s", row.log_type, row.status)
        wanted = _versions([row for row in found if row.status == LOADED])
        return Model(**{name: _read(spark, path, name).where(wanted).drop("version") for name in TABLES})


def _versions(rows: list) -> Column:
    """Condition on the partition columns that picks each row's log type in its version, so that no other file is opened."""
    types: dict[str, list[str]] = {}
    for row in rows:
        types.setdefault(row.version, []).append(row.log_type)
    parts = [(F.col("version") == v) & F.col("log_type").isin(named) for v, named in sorted(types.items())]
    return reduce(Column.__or__, parts, F.lit(False))


def _read(spark: SparkSession, path: str, name: str, **options) -> DataFrame:
    """One table of the store in all versions; empty if its folder is missing."""
    schema = T.StructType.fromDDL(f"{TABLES[name]}, version string")
    try:
        return spark.read.options(**options).schema(schema).parquet(f"{path}/{name}")
    except AnalysisException:
        return spark.createDataFrame([], schema)


def _contents(spark: SparkSession, path: str, where: Column) -> DataFrame:
    """(version, log_type, table, rows, digest) of what the store holds; unreadable files hold nothing."""
    parts = []
    for name in TABLES:
        table = _read(spark, path, name, ignoreCorruptFiles=True, ignoreMissingFiles=True).where(where)
        digest = F.bit_xor(F.xxhash64(*[_text(field) for field in table.schema if field.name not in ("version", "log_type")]))
        counted = table.groupBy("version", "log_type").agg(F.count(F.lit(1)).alias("rows"), digest.alias("digest"))
        parts.append(counted.withColumn("table", F.lit(name)))
    return reduce(DataFrame.unionByName, parts)


def _text(field: T.StructField) -> Column:
    """A column in a form that can be hashed."""
    if isinstance(field.dataType, T.MapType):
        return F.to_json(F.array_sort(F.map_entries(c(field.name))))
    return c(field.name)


def in_force(spark: SparkSession, path: str) -> DataFrame:
    """The latest manifest row per log type: (log_type, version, tables)."""
    try:
        entries = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    except AnalysisException:
        return spark.createDataFrame([], MANIFEST)
    latest = F.max_by(F.struct("version", "tables"), "version").alias("latest")
    return entries.groupBy("log_type").agg(latest).select("log_type", "latest.*")


def store_status(spark: SparkSession, path: str) -> DataFrame:
    """(log_type, version, status) of every stored log type: loaded, or what is wrong with its tables."""
    named = stage(in_force(spark, path), "manifest")
    there = _contents(spark, path, _versions(named.select("log_type", "version").collect()))
    held = there.groupBy("log_type").agg(
        F.map_from_entries(F.collect_list(F.struct("table", F.struct("rows", "digest")))).alias("held")
    )
    both = named.join(held, "log_type", "left")

    def wrong(name: str) -> Column:
        want, got = F.col("tables")[name], F.col("held")[name]
        text = F.format_string(f"{name}: %d of %d rows", F.coalesce(got["rows"], F.lit(0)), want["rows"])
        changed = F.when(got["rows"] == want["rows"], F.lit(f"{name}: changed")).otherwise(text)
        return F.when(want.isNotNull() & ~got.eqNullSafe(want), changed)

    faults = F.concat_ws("; ", *[wrong(name) for name in TABLES])
    status = F.when(faults != "", faults).when(F.col("tables")["forest"].isNull(), WITHOUT_FOREST).otherwise(LOADED)
    return both.select("log_type", "version", status.alias("status"))
