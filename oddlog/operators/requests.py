"""Scoring requests: one JSON text per row, checked before scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.names import c
from ..functions.scoring import DEFAULT_THRESHOLD

MISSING = "Missing 'event_data' in request"
BAD_JSON = "Invalid JSON in request body"
BAD_THRESHOLD = "anomaly_threshold must be a number"


def read_requests(df: DataFrame, body: str, event_schema: T.StructType) -> DataFrame:
    """Add ``event_data``, ``log_type``, ``anomaly_threshold`` and ``error`` from the request text.

    A request without a threshold gets the default. A row with an error has no event data; it is kept.
    """
    parsed = F.try_parse_json(c(body))
    event = F.try_variant_get(parsed, "$.event_data", event_schema.simpleString())
    given = F.try_variant_get(parsed, "$.anomaly_threshold", "double")
    # a number, not text that looks like one
    stated = F.try_variant_get(parsed, "$.anomaly_threshold", "variant")
    kind = F.schema_of_variant(stated)
    numeric = stated.isNull() | kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    has_event = F.try_variant_get(parsed, "$.event_data", "variant").isNotNull()
    error = (
        F.when(parsed.isNull(), BAD_JSON).when(~has_event, MISSING).when(~numeric, BAD_THRESHOLD)
    )
    return df.withColumns(
        {
            "error": error,
            "event_data": F.when(error.isNull(), event),
            "log_type": F.when(error.isNull(), F.try_variant_get(parsed, "$.log_type", "string")),
            "anomaly_threshold": F.when(error.isNull(), F.coalesce(given, F.lit(DEFAULT_THRESHOLD))),
        }
    )
