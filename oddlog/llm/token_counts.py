"""Token counts through a cache of digests.

The cache is a Parquet table (tokenizer, digest, n_tokens). Texts are joined to it by the digest of their normalised
content and the digest of the tokenizer (file and library version). Only distinct misses are encoded, one text per
digest, and their counts are appended. A second run over the same texts encodes nothing; another tokenizer or library
version never meets counts that are not its own.

Normalising replaces the visible space mark U+2581 by a space, which the tokenizer does itself, so equal digests have
equal counts. A null text is an empty one: 0 tokens, 0 bytes.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from oddlog.session import new_path

from .common import slices, text_batches

MARK = "▁"
ROOM = 1 << 18  # words whose counts a worker remembers
LAST = {"": 1}  # what is left of a single space at the end of a text: the library's own mark, one token
SCHEMA = "tokenizer string, digest binary, n_tokens long"


class Counter:
    """Counts as the library gives them, word by word where that is provably the same.

    If no piece holds a space mark after another character, and the normaliser keeps texts as they are, no merge crosses
    the beginning of a run of spaces. A text then has as many tokens as its words, each with the spaces before it. The
    library puts a mark of its own in front, which stands for one of these spaces.
    """

    def __init__(self, model: bytes):
        self.model = model
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = map(self.library.id_to_piece, range(self.library.get_piece_size()))
        crossing = any(MARK in piece.lstrip(MARK) for piece in pieces)
        plain = [self.library.encode(text) for text in ("a  b ", "① ﬁ")]
        kept = [self.library.decode(ids) for ids in plain] == ["a  b ", "① ﬁ"]
        self.by_word = kept and not crossing and len(self.library.encode(" ")) == 1
        self.words = re.compile(f"[ {MARK}]*[^ {MARK}]+|[ {MARK}]+$")
        self.known: dict[str, int] = dict(LAST)

    def __reduce__(self):
        return Counter, (self.model,)

    def split(self, text: str) -> list[str]:
        if MARK in text or "  " in text or text.startswith(" ") or text.endswith(" "):
            first, *rest = self.words.findall(text)
            return [first] + [word[1:] for word in rest]
        return text.split(" ")

    def count(self, texts: list[str]) -> list[int]:
        if not self.by_word:
            return [len(ids) for ids in self.library.encode(texts, num_threads=1)]
        split = [self.split(text) if text else [] for text in texts]
        new = {word for words in split for word in words}.difference(self.known)
        if len(self.known) + len(new) > ROOM:
            self.known = dict(LAST)
            new = {word for words in split for word in words}.difference(LAST)
        order = list(new)
        self.known.update(zip(order, map(len, self.library.encode(order, num_threads=1))))
        return [sum(map(self.known.__getitem__, words)) for words in split]


def version(model: bytes) -> str:
    return hashlib.sha256(model + sentencepiece.__version__.encode()).hexdigest()


def digest(text: Column) -> Column:
    """Digest (32 bytes) of the normalised content of a text."""
    return F.unhex(F.sha2(F.translate(F.coalesce(text, F.lit("")), MARK, " "), 256))


def counter(spark: SparkSession, model: bytes):
    shared = text_batches(spark).sparkContext.broadcast(Counter(model))

    @F.arrow_udf("long")
    def counts(texts: pa.Array) -> pa.Array:
        return pa.array(np.concatenate([shared.value.count(part) for part in slices(texts)] or [[]]).astype(np.int64))

    return counts


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The stored counts; none yet if nothing has been written there."""
    try:
        return spark.read.schema(SCHEMA).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SCHEMA)


def add_misses(docs: DataFrame, model: bytes, path: str, text_col: str = "text") -> None:
    """Encode every distinct content of ``docs`` that the cache at ``path`` lacks, and append its count.

    Copies are reduced to one per task before the shuffle. A job that fails appends nothing.
    """
    spark = docs.sparkSession
    mine = read_cache(spark, path).where(F.col("tokenizer") == version(model)).select("digest")
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(digest(text).alias("digest"), text.alias("text"))
    misses = keyed.join(mine, "digest", "left_anti").groupBy("digest").agg(F.first("text").alias("text"))
    count = counter(spark, model)(F.col("text")).alias("n_tokens")
    counted = misses.select(F.lit(version(model)).alias("tokenizer"), "digest", count)
    counted.write.mode("append").parquet(path)


def count_tokens(
    docs: DataFrame, model_path: str, cache: str | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every row. Without ``cache`` a new one is begun in the shared work folder.

    Repeated rows and ids keep their rows. The cache may hold a digest twice if two jobs append at once; that does not
    multiply rows.
    """
    spark = docs.sparkSession
    with open(model_path, "rb") as file:
        model = file.read()
    path = cache or new_path(spark, "token-counts")
    add_misses(docs, model, path, text_col)
    mine = read_cache(spark, path).where(F.col("tokenizer") == version(model))
    stored = mine.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_bytes"),
        digest(F.col(text_col)).alias("digest"),
    )
    return rows.join(stored, "digest").select("doc_id", "n_bytes", "n_tokens")
