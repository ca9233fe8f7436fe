"""Scoring on Structured Streaming: the batch transform is stateless and map-only, so it is used as it is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.scoring import DEFAULT_THRESHOLD
from ..operators.detect import Scorer, alerts, detect
from ..sources.logs import with_corrupt
from ..sources.models import Model


def read_events(
    spark: SparkSession, path: str, schema: T.StructType, fmt: str = "json", corrupt: str | None = None, **options
) -> DataFrame:
    """A stream of event files; the schema must be given, a stream cannot look ahead.

    ``corrupt`` names a column for text that is no JSON; detection gives such events their own error.
    """
    if corrupt:
        schema, options = with_corrupt(schema, corrupt), {**options, "columnNameOfCorruptRecord": corrupt}
    return spark.readStream.schema(schema).format(fmt).options(**options).load(path)


def detect_stream(
    events: DataFrame, model: Model | Scorer, threshold: float | Column = DEFAULT_THRESHOLD, **kwargs
) -> DataFrame:
    """Result rows of a stream of events."""
    return detect(events, model, threshold, **kwargs)


def write_results(
    results: DataFrame, path: str, checkpoint: str, only_alerts: bool = False, available_now: bool = True
) -> StreamingQuery:
    """Append result rows (or only the anomalies) to a Parquet folder, exactly once per event."""
    rows = alerts(results) if only_alerts else results
    writer = rows.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer
    return writer.start(path)


def dedupe_stream(events: DataFrame, key: Column, time: str, window_days: int) -> DataFrame:
    """First arrival of every key; keys are forgotten, and events dropped, once they are older than the window.

    State is spread over the cluster by key. A hot key keeps one entry.
    """
    if isinstance(events.schema[time].dataType, T.TimestampNTZType):
        events = events.withColumn(time, F.col(time).cast("timestamp"))
    return (
        events.withColumn("log_id", key)
        .withWatermark(time, f"{window_days} days")
        .dropDuplicatesWithinWatermark(["log_id"])
    )


PROGRESS = "batch_id bigint, rows bigint, rows_per_second double, duration_ms bigint, started string"


def run_metrics(spark: SparkSession, query: StreamingQuery) -> DataFrame:
    """One row per micro-batch that the engine still remembers (100 by default): rows read, speed and duration."""
    found = [
        (p.batchId, p.numInputRows, float(p.processedRowsPerSecond), int(p.durationMs["triggerExecution"]), p.timestamp)
        for p in query.recentProgress
        if p.numInputRows
    ]
    return spark.createDataFrame(found, PROGRESS)
