"""Alerts handed on once: every micro-batch is written under its number, and a ledger says which ones are done."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.detect import alerts

LEDGER = "query string, batch bigint, alerts bigint"
SEND = Callable[[DataFrame, int], None]


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """One row per micro-batch that was handed on: stream name, batch number and number of alerts."""
    try:
        return spark.read.schema(LEDGER).parquet(f"{path}/ledger")
    except AnalysisException:  # nothing was handed on yet
        return spark.createDataFrame([], LEDGER)


def deliver(batch: DataFrame, number: int, path: str, name: str, send: SEND | None = None) -> bool:
    """Hand on the alerts of micro-batch ``number`` of the stream ``name``, unless the ledger has it; whether it did.

    The alerts are written to a folder of that number, which a replay replaces, and the ledger's row comes last. A crash
    between the two leaves a folder that no reader sees and that the replay writes again. ``send`` passes stored alerts
    on to another system; only a crash between it and the ledger lets it see a batch twice, with the same number.
    """
    spark = batch.sparkSession
    if ledger(spark, path).where((F.col("query") == name) & (F.col("batch") == number)).count():
        return False
    counted, folder = Observation(), f"{path}/alerts/query={name}/batch={number}"
    rows = batch.observe(counted, F.count(F.lit(1)).alias("alerts"))
    rows.write.mode("overwrite").parquet(folder)
    if send:
        send(spark.read.schema(batch.schema).parquet(folder), number)
    entry = spark.createDataFrame([(name, number, counted.get["alerts"])], LEDGER).coalesce(1)
    entry.drop("query", "batch").write.mode("overwrite").parquet(f"{path}/ledger/query={name}/batch={number}")
    return True


def forward_alerts(
    results: DataFrame, path: str, checkpoint: str, name: str, send: SEND | None = None, available_now: bool = True
) -> StreamingQuery:
    """Hand on the anomalies of a stream of result rows, each micro-batch once. ``name`` stays over restarts."""
    writer = alerts(results).writeStream.queryName(name).option("checkpointLocation", checkpoint)
    writer = writer.foreachBatch(lambda batch, number: deliver(batch, number, path, name, send) and None)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def forwarded(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The alerts of all finished micro-batches, with ``query`` and ``batch``; ``schema`` is that of the result rows."""
    whole = T.StructType([*schema.fields, *T.StructType.fromDDL("query string, batch bigint").fields])
    done = ledger(spark, path).select("query", "batch")
    try:
        return spark.read.schema(whole).parquet(f"{path}/alerts").join(done, ["query", "batch"], "left_semi")
    except AnalysisException:
        return spark.createDataFrame([], whole)
