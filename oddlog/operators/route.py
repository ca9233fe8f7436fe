"""Which model an event belongs to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.names import (
    ALERT_FIELDS,
    ALERT_LOG_TYPE,
    AUDIT_FIELDS,
    AUDIT_LOG_TYPE,
    SOURCE_FIELD,
    SOURCE_TO_LOG_TYPE,
    c,
)


def _any_present(df: DataFrame, fields: tuple[str, ...]) -> Column:
    found = [c(f).isNotNull() for f in fields if f in df.columns]
    hit = F.lit(False)
    for test in found:
        hit = hit | test
    return hit


def route(
    df: DataFrame,
    available: list[str],
    explicit: str | None = None,
    sources: dict[str, str] = SOURCE_TO_LOG_TYPE,
    source_field: str = SOURCE_FIELD,
) -> Column:
    """Log type of each (flattened) event, null when nothing fits.

    An explicit log type wins, whether or not a model exists. Then the event source decides, then alert-like and
    audit-like top-level fields; these three only name models in ``available``.
    """
    mapped = F.lit(None).cast("string")
    if source_field in df.columns:
        name = F.lower(c(source_field).cast("string"))
        for source, log_type in sources.items():
            if log_type in available:
                mapped = F.coalesce(mapped, F.when(name == source, log_type))
    choices = [c(explicit).cast("string")] if explicit else []
    choices.append(mapped)
    if ALERT_LOG_TYPE in available:
        choices.append(F.when(_any_present(df, ALERT_FIELDS), ALERT_LOG_TYPE))
    if AUDIT_LOG_TYPE in available:
        choices.append(F.when(_any_present(df, AUDIT_FIELDS), AUDIT_LOG_TYPE))
    return F.coalesce(*choices)


def missing_model(log_type: Column) -> Column:
    """Error text of an event without a model."""
    return F.concat(F.lit("No model available for log type: "), F.coalesce(log_type, F.lit("None")))
