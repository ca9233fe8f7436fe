"""Helpers shared by the text operators."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from oddlog.session import stage

LETTERS = re.compile(r"[^\W\d_]+")
SLICE_BYTES = 1 << 20  # text handled at once by a Python task
BATCH_ROWS = 1000  # texts handed to a Python task at once

__all__ = ["LETTERS", "table", "stage", "text_batches", "released", "group_key", "fold", "slices", "ragged", "batch", "nested", "unnested", "drawn", "crc32_sql", "Scores"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_batches(spark: SparkSession) -> SparkSession:
    """The session, set to hand texts to Python in batches of at most ``BATCH_ROWS``.

    Texts, and the ids or spans made of them, are much longer than the rows that Spark's own size is meant for.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    return spark


@contextmanager
def released(spark: SparkSession):
    """Within it, the shuffle files of a staged table are deleted as soon as the table is written."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def group_key(value: Column) -> Column:
    """A value as a text that is never null and, for texts, sorts bytewise with null first."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit(""))


def fold(key: Column, parts: int, remainder: int) -> Column:
    """True where crc32 of the key as text leaves ``remainder``; a null key belongs to no such fold."""
    return F.coalesce(F.crc32(key.cast("string")) % parts == remainder, F.lit(False))


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[list[str]]:
    """The texts of an Arrow column in portions of about ``limit`` bytes, null as empty, at least one text each."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(column):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield [t or "" for t in column.slice(start, stop - start).to_pylist()]
        start = stop


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the concatenated ranges [start, start + length)."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.arange(total) + np.repeat(starts - before, lengths)


def batch(kinds: dict[str, pa.DataType], columns) -> pa.RecordBatch:
    """A record batch from columns in the order of ``kinds``."""
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values())], names=list(kinds))


def nested(rows: DataFrame) -> Column:
    """All columns of a row in one struct, so that an operator's own columns cannot clash with them."""
    return F.struct(*(rows[c] for c in rows.columns)).alias("row")


def unnested(rows: DataFrame, names: list[str], *new: str) -> DataFrame:
    """The columns ``names`` of ``row`` again, with ``new`` ones in place of equal names."""
    return rows.select(*(F.col("row")[c].alias(c) for c in names if c not in new), *new)


def drawn(key: Column, share: Column | float) -> Column:
    """True for about ``share`` of the keys, always the same ones."""
    return F.pmod(F.xxhash64(key, F.lit("drawn")), F.lit(1_000_003)) < share * 1_000_003


def crc32_sql(text: str) -> str:
    """The unsigned CRC-32 of an ASCII text as SQL that has no such function, bit by bit."""
    bit = "lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
    byte = f"lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), {bit})"
    codes = f"list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), {byte}), 4294967295)"


class Scores:
    """Rows of numbers per word, worked out at a word's first use and kept while there is room."""

    def __init__(self, width: int, work_out: Callable[[str], np.ndarray], room: int = 1 << 18):
        self.width, self.work_out, self.room = width, work_out, room
        self.forget()

    def forget(self) -> None:
        self.places: dict[str, int] = {}
        self.rows = np.zeros((1 << 12, self.width))

    def of(self, words: list[str]) -> np.ndarray:
        """The rows of all words, in order."""
        new = set(words).difference(self.places)
        if len(self.places) + len(new) > self.room:
            self.forget()
            new = set(words)
        first = len(self.places)
        if first + len(new) > len(self.rows):
            grown = np.zeros((2 * (first + len(new)), self.width))
            grown[:first] = self.rows[:first]
            self.rows = grown
        for place, word in enumerate(new, first):
            self.rows[place] = self.work_out(word)
            self.places[word] = place
        return self.rows[np.fromiter(map(self.places.__getitem__, words), np.int64, len(words))]
