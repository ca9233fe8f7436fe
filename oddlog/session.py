"""Session helper and the shared work area used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

CHECKPOINT_DIR = "spark.checkpoint.dir"
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 32 << 20  # of a table's files
FILE_ROWS = 200_000  # of a stored file that several costly passes read


def get_spark(app: str = "oddlog", master: str | None = None, conf: dict[str, str] | None = None) -> SparkSession:
    """A session with the settings the engine is tuned for; cluster defaults win unless named in ``conf``."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.caseSensitive": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
    }
    settings.update(conf or {})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_dir(spark: SparkSession) -> str:
    """The shared folder for written intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session, where driver and executors share one
    disk, may fall back to a temporary folder.
    """
    folder = spark.conf.get(CHECKPOINT_DIR, None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all executors can reach")
    folder = tempfile.mkdtemp(prefix="oddlog-")
    spark.conf.set(CHECKPOINT_DIR, folder)
    return folder


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh, unused path below the work folder."""
    return f"{work_dir(spark)}/oddlog/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str, file_rows: int = 0) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Used where several later passes need one expensive intermediate. The table survives the loss of any executor and
    reads back column by column, which neither a cache nor an RDD checkpoint gives. A written file is one row group, which
    one task reads whole; ``file_rows`` bounds it, so that later passes find work for many tasks. No rows are shuffled.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("maxRecordsPerFile", file_rows).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def uneven(df: DataFrame) -> bool:
    """Whether one task would read over twice its share of ``df``, and more rows than a stored file holds.

    That is so for a table of few row groups, however many splits it has. Counting the rows of each split reads no column.
    """
    sizes = df.groupBy(F.spark_partition_id().alias("split")).agg(F.count(F.lit(1)).alias("n"))
    most, total = sizes.agg(F.max("n"), F.sum("n")).first()
    return (most or 0) > FILE_ROWS and most * df.sparkSession.sparkContext.defaultParallelism > 2 * total


def spread(df: DataFrame, label: str) -> DataFrame:
    """``df``, or a copy stored in small files if few tasks would do most of every pass over it.

    Types that Parquet does not hold are left as they are, and so is their table.
    """
    odd = (T.NullType, T.VariantType, T.CalendarIntervalType)
    if any(isinstance(f.dataType, odd) for f in df.schema.fields) or not uneven(df):
        return df
    return stage(df, label, FILE_ROWS)


def plan_bytes(df: DataFrame) -> int:
    """Bytes the optimizer expects; for a table read from files, their size. Needs no job."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def fits(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether a stored table is small enough to be broadcast, by its bytes and its rows."""
    return plan_bytes(df) <= size and df.count() <= rows


def join_side(df: DataFrame, label: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A derived table made ready to be joined to a large one: written once, and broadcast if it proved small.

    Left to itself, adaptive execution would learn the size only after it had shuffled the large side as well. Beyond
    ``limit`` rows or ``BROADCAST_BYTES`` the table is joined by shuffle, where adaptive execution splits skewed keys.
    """
    staged = stage(df, label)
    return F.broadcast(staged) if fits(staged, limit) else staged
