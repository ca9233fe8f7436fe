"""A text corpus made ready for training, stage by stage.

Each stage takes what the one before it kept, and but for the last returns the columns of ``documents``:

* ``language``: documents without a letter go, and those whose best score is hardly above chance (``ABOVE_CHANCE`` over the
  number of languages, at most a half); a short document of unseen words is no reason to doubt.
* ``near_duplicates``: of documents whose SimHash fingerprints differ in at most four bits, or whose five-word shingles are
  alike by 0.8 or more (many of these differ in more bits), over chains of such pairs, the one with the smallest id stays.
* ``repeats``: stretches of 200 bytes or more that occur elsewhere are cut out; documents with nothing left go.
* ``mixing``: documents are drawn so that sources, languages and topics have their raked shares without any weights; the
  weights are raked within what each cell has, so that a rare cell does not decide how much is kept.
* ``byte_bpe``: texts become ids; ``round_trip`` says that the ids decode to the text.

Rows with null texts go in the first stage. Empty tables pass through. Extra columns are kept but for the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from oddlog.llm import byte_bpe, language, mixing, near_copies, repeats, simhash
from oddlog.llm.common import nested, stage, table, unnested

ABOVE_CHANCE = 1.25
ROOM = 24 << 20  # bytes of a turn of the encoder's memo: its workers still hold memory of the stages before
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

ORACLE_SQL = None


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language.fit(docs)
    least = min(0.5, ABOVE_CHANCE / max(1, len(model.languages)))
    found = docs.select(nested(docs), language.identify(docs, model).alias("found"))
    sure = (F.col("found.lang") != language.UNKNOWN) & (F.col("found.score") >= least)
    return unnested(found.where(sure), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    near = simhash.near_groups(docs).select(F.col("doc_id").alias("id"), F.col("component_id").alias("group"))
    return near_copies.keep_one(docs, groups=near)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = repeats.without_repeats(docs.select(nested(docs), "doc_id", "text"), as_text=True).where("cut.kept <> ''")
    size = F.char_length("cut.kept").cast("long").alias("n_chars")
    return unnested(cut.select("row", F.col("cut.kept").alias("text"), size), docs.columns, "text", "n_chars").select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = mixing.mix(docs.select(nested(docs), "doc_id", "text", "source", "lang"), rate=None)
    return unnested(kept, docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    coded = byte_bpe.encode(docs.select("doc_id", "source", "lang", "text"), RANKS, public_tokenizers.PATTERN, room=ROOM)
    both = byte_bpe.decode(coded, RANKS)
    same = F.col("decoded") == F.encode("text", "UTF-8")
    size = F.size("ids").cast("long").alias("n_tokens")
    return both.select("doc_id", "source", "lang", size, "ids", same.alias("round_trip"))


STAGES = [
    ("language", known_language),
    ("near_duplicates", near_duplicates),
    ("repeats", without_repeats),
    ("mixing", mixed),
    ("byte_bpe", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name)
    return docs
