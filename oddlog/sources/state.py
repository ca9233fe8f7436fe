"""Ingest state: one row per query title."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import new_path

SCHEMA = (
    "title string, window_days int, last_run string, last_data_timestamp string, record_count bigint,"
    " created_at string, updated_at string"
)


def stamp(as_of: datetime | str) -> str:
    text = as_of.isoformat() if isinstance(as_of, datetime) else as_of.replace(" ", "T")
    return text if text.endswith("Z") else text + "Z"


def initial(titles: DataFrame, as_of: datetime | str) -> DataFrame:
    """State of titles that never ran, from rows of (title, window_days)."""
    now = F.lit(stamp(as_of))
    return titles.select(
        "title",
        F.col("window_days").cast("int").alias("window_days"),
        F.lit(None).cast("string").alias("last_run"),
        F.lit(None).cast("string").alias("last_data_timestamp"),
        F.lit(0).cast("bigint").alias("record_count"),
        now.alias("created_at"),
        now.alias("updated_at"),
    )


def after_run(state: DataFrame, runs: DataFrame, as_of: datetime | str) -> DataFrame:
    """State rows of the titles in ``runs`` (title, latest_timestamp, n_logs) after a successful run.

    ``created_at`` is kept, ``updated_at`` and ``last_run`` are renewed.
    """
    now = F.lit(stamp(as_of))
    return state.join(runs, "title").select(
        "title",
        "window_days",
        now.alias("last_run"),
        F.col("latest_timestamp").alias("last_data_timestamp"),
        F.col("n_logs").cast("bigint").alias("record_count"),
        "created_at",
        now.alias("updated_at"),
    )


def upsert(state: DataFrame, rows: DataFrame) -> DataFrame:
    """Replace or add titles."""
    return state.join(rows.select("title"), "title", "left_anti").unionByName(rows)


def delete(state: DataFrame, title: str | Column) -> DataFrame:
    return state.where(F.col("title") != title)


def titles(state: DataFrame) -> DataFrame:
    return state.select("title").orderBy("title")


def get(state: DataFrame, title: str) -> DataFrame:
    return state.where(F.col("title") == title)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def save(state: DataFrame, path: str) -> None:
    """Replace the stored table; it is written aside first because ``state`` may read from ``path``."""
    spark = state.sparkSession
    aside = new_path(spark, "state")
    state.write.parquet(aside)
    spark.read.schema(SCHEMA).parquet(aside).coalesce(1).write.mode("overwrite").parquet(path)
