"""Pages of a large table, cut in advance from one weighed histogram of its keys.

``logs.pages`` finds each page by reading on from the last one, two jobs a page. Here the table is read once for a
histogram (rows and bytes of every key); running sums over it say in which page a key falls, and a second read hands
out all pages, however many there are.

A page starts every time the running weight passes another full page. Weight is counted in rows and in bytes, the larger
of both in each key, so that a page stays within both limits but for what its last key holds beyond them: a key is never
cut. Page numbers ascend and leave numbers out where one key fills several pages. Rows without a key come first, as one
key of their own. Keys are numbers, texts, dates or times. An empty table has no pages.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.names import c
from ..operators.flatten import record_size
from ..session import BROADCAST_ROWS, fits, stage
from .logs import CHUNK_BYTES

KEYS_PER_TASK = 1_000_000


def key_histogram(df: DataFrame, key: str) -> DataFrame:
    """(key, n_logs, bytes): one row per key, counted before the shuffle."""
    return (
        df.select(c(key).alias("key"), record_size(df).alias("size"))
        .groupBy("key")
        .agg(F.count(F.lit(1)).alias("n_logs"), F.sum("size").alias("bytes"))
    )


def running_weight(keys: DataFrame, keys_per_task: int = KEYS_PER_TASK) -> DataFrame:
    """Add ``before``, the weight of all smaller keys.

    Ranges of keys are summed apart and moved on by the total of the ranges before them; only these totals, one per
    range, come together in one task. Keys are distinct here, so no range can be hot.
    """
    parts = max(1, -(-keys.count() // keys_per_task))
    ranged = keys.repartitionByRange(parts, "key").withColumn("part", F.spark_partition_id())
    ranged = stage(ranged, "key-ranges")  # a part number must be the same in both of its uses
    earlier = Window.rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("part").agg(F.sum("weight").alias("total"))
    offsets = totals.select("part", F.sum("total").over(earlier.orderBy("part")).alias("offset"))
    inside = F.sum("weight").over(earlier.partitionBy("part").orderBy("key"))
    joined = ranged.withColumn("inside", inside).join(F.broadcast(offsets) if parts <= BROADCAST_ROWS else offsets, "part")
    zero = F.lit(0).cast("decimal(38,0)")
    return joined.withColumn("before", F.coalesce("inside", zero) + F.coalesce("offset", zero)).drop("part", "inside", "offset")


@dataclass
class Paging:
    """Pages of one table: ``keys`` (key, n_logs, bytes, page) and ``plan`` (page, first_key, last_key, keys, n_logs, bytes)."""

    key: str
    keys: DataFrame
    plan: DataFrame

    def number(self, df: DataFrame, name: str = "page", lookup: int = BROADCAST_ROWS) -> DataFrame:
        """Add the page of every row; a column already called ``name`` is replaced.

        Rows are joined to the keys. Up to ``lookup`` keys are broadcast; if they are more, or large, both sides are
        shuffled, where adaptive execution splits hot keys. Either way a row costs the same whatever the number of pages.
        """
        rows = df.select(F.struct(*[c(n) for n in df.columns if n != name]).alias("row"), c(self.key).alias("key"))
        found = self.keys.select(F.col("key").alias("known"), "page")
        side = F.broadcast(found) if fits(self.keys, min(lookup, BROADCAST_ROWS)) else found
        return rows.join(side, F.col("key").eqNullSafe(F.col("known"))).select("row.*", F.col("page").alias(name))

    def each(self, df: DataFrame) -> Iterator[tuple[int, DataFrame]]:
        """Number and rows of every page in order, as a range of keys that reaches the scan: cheap on a table sorted by key.

        The driver fetches the plan piece by piece, one short row per page.
        """
        dtype = self.plan.schema["first_key"].dataType
        bounds = [F.col(n).cast("string").alias(n) for n in ("first_key", "last_key")]
        for row in self.plan.orderBy("page").select("page", *bounds).toLocalIterator():
            first, last = (F.lit(row[n]).cast(dtype) for n in ("first_key", "last_key"))
            if row.last_key is None:
                inside = c(self.key).isNull()
            elif row.first_key is None:
                inside = c(self.key).isNull() | (c(self.key) <= last)
            else:
                inside = (c(self.key) >= first) & (c(self.key) <= last)
            yield row.page, df.where(inside)


def plan_pages(
    df: DataFrame, key: str, size: int, most_bytes: int = CHUNK_BYTES, keys_per_task: int = KEYS_PER_TASK
) -> Paging:
    """Cut ``df`` into pages of ``size`` rows and ``most_bytes`` bytes in the order of ``key``, reading it once."""
    if size < 1 or most_bytes < 1:
        raise ValueError("a page needs room for one row and one byte")
    wide = "decimal(19,0)"
    # in units of 1 / (size * most_bytes) page, so that sums are whole numbers in any order
    weight = F.greatest(
        F.col("n_logs").cast(wide) * F.lit(most_bytes).cast(wide), F.col("bytes").cast(wide) * F.lit(size).cast(wide)
    )
    keys = stage(key_histogram(df, key), "key-histogram").withColumn("weight", weight)
    page = F.expr(f"before div cast({size * most_bytes} AS decimal(38,0))")
    numbered = running_weight(keys, keys_per_task).select("key", "n_logs", "bytes", page.alias("page"))
    numbered = stage(numbered, "key-pages")
    plan = numbered.groupBy("page").agg(
        F.when(F.count("key") == F.count(F.lit(1)), F.min("key")).alias("first_key"),
        F.max("key").alias("last_key"),
        F.count(F.lit(1)).alias("keys"),
        F.sum("n_logs").alias("n_logs"),
        F.sum("bytes").alias("bytes"),
    )
    return Paging(key, numbered, stage(plan, "page-plan"))


def write_pages(df: DataFrame, paging: Paging, path: str, name: str = "page") -> None:
    """One folder per page, all written by one job.

    Rows are brought together by page; adaptive execution joins small pages to one task and splits a page whose one
    key is larger than a task should be.
    """
    paging.number(df, name).hint("rebalance", c(name)).write.mode("overwrite").partitionBy(name).parquet(path)


def read_page(spark: SparkSession, path: str, page: int, name: str = "page") -> DataFrame:
    """The rows of one written page; no other page is touched."""
    return spark.read.parquet(path).where(c(name) == page).drop(name)
