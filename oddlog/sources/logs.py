"""Log tables: reading, writing, bounded extracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.names import c
from ..operators.flatten import record_size

# Fixed values of the size-bounded extract.
CHUNK_BYTES, SAMPLE_ROWS, MIN_CHUNK, SMALLEST_CHUNK = 80_000_000, 1000, 1000, 500


def with_corrupt(schema: T.StructType, corrupt: str | None) -> T.StructType:
    """``schema`` with a text column for what is no JSON."""
    if corrupt is None or corrupt in schema.names:
        return schema
    return T.StructType([*schema.fields, T.StructField(corrupt, T.StringType())])


def read_json_logs(
    spark: SparkSession, path: str, schema: T.StructType | None = None, lines: bool = True, corrupt: str | None = None
) -> DataFrame:
    """JSON logs, one object per line; ``lines=False`` for files holding one array. No rows is an error.

    Files of lines are split across tasks, a file holding one array is read by a single task. ``corrupt`` names a column
    for the text of lines that cannot be parsed, which detection reports as such.
    """
    reader = spark.read.schema(with_corrupt(schema, corrupt)) if schema else spark.read
    if corrupt:
        reader = reader.option("columnNameOfCorruptRecord", corrupt)
    df = reader.option("multiLine", str(not lines).lower()).json(path)
    if not df.columns or df.isEmpty():
        raise ValueError(f"no data found in {path}")
    return df


def read_table(spark: SparkSession, name: str, spread: int | None = None) -> DataFrame:
    """A lake table by catalogue name, or a Parquet folder by path.

    A task reads whole row groups. ``spread`` deals the rows of a table with fewer splits than that over so many
    tasks, worth one shuffle when costly steps such as scoring follow; a table with enough splits is read as it is.
    """
    df = spark.read.parquet(name) if "/" in name else spark.table(name)
    if spread and df.rdd.getNumPartitions() < spread:
        return df.repartition(spread)
    return df


def param_query(spark: SparkSession, sql: str, args: dict, **tables: DataFrame) -> DataFrame:
    """SQL with named parameters and table arguments; values are bound, never pasted into the text."""
    return spark.sql(sql, args=args, **tables)


def write_dataset(df: DataFrame, path: str, by: str = "log_type", rows_per_file: int | None = None) -> None:
    """Replace the datasets of the log types in ``df``; others stay.

    ``rows_per_file`` bounds every output file, the distributed form of a chunked extract.
    """
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by)
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    writer.parquet(path)


def chunk_size(sample: DataFrame) -> DataFrame:
    """Rows per chunk so that a chunk stays within 80 MB, at least 1000, from the sample's average record size."""
    size = F.avg(record_size(sample))
    rows = F.floor(F.lit(float(CHUNK_BYTES)) / size).cast("bigint")
    return sample.agg(
        F.count(F.lit(1)).alias("sampled"),
        F.greatest(F.coalesce(rows, F.lit(MIN_CHUNK)), F.lit(MIN_CHUNK)).cast("bigint").alias("chunk_rows"),
    )


def halved(chunk_rows: int) -> int:
    """Next chunk size after a chunk proved too large."""
    return max(chunk_rows // 2, SMALLEST_CHUNK)


def page(df: DataFrame, key: str, size: int, after=None) -> DataFrame:
    """The next ``size`` rows in key order after the key ``after``, and all further rows of the page's last key.

    Pages continue from the last key instead of counting an offset, so a late page costs no more than the first and
    the filter reaches the scan. As a key is never cut, pages cover every row once even if keys repeat. Rows without a
    key are part of the first page.
    """
    rest = df if after is None else df.where(c(key) > F.lit(after))
    last = rest.where(c(key).isNotNull()).orderBy(c(key)).limit(size).agg(F.max(c(key))).first()[0]
    if last is None:
        return rest
    inside = c(key) <= F.lit(last)
    return rest.where(inside | c(key).isNull() if after is None else inside)


def pages(df: DataFrame, key: str, size: int, most_bytes: int = CHUNK_BYTES):
    """All pages of a table from first to last; one that holds more than ``most_bytes`` is read again at half the size.

    Yields DataFrames; of each the driver reads its row count, bytes and last key.
    """
    after = None
    while True:
        rows = page(df, key, size, after)
        n, held, last = rows.agg(F.count(F.lit(1)), F.sum(record_size(rows)), F.max(c(key))).first()
        if n and held > most_bytes and halved(size) < size:
            size = halved(size)
            continue
        if n:
            yield rows
        if not n or last is None:
            return
        after = last


def offset_page(df: DataFrame, key: str, size: int, offset: int) -> DataFrame:
    """``LIMIT size OFFSET offset`` in key order."""
    return df.orderBy(c(key)).offset(offset).limit(size)
