"""Registered queries of the text operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from oddlog.session import new_path

from . import (
    byte_bpe,
    conversations,
    fingerprints,
    language,
    merkle,
    mixing,
    pivot_search,
    repeats,
    simhash,
    templates,
    token_counts,
    toxicity,
    warc,
)
from .common import crc32_sql, fold, group_key, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op1_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    coded = byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN).select("doc_id", "ids")
    both = byte_bpe.decode(coded, RANKS)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        byte_bpe.ids_digest(F.col("ids")).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op2_simhash(spark: SparkSession, folder: str) -> DataFrame:
    groups = simhash.near_groups(table(spark, folder, "documents"))
    return groups.select("doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


@query
def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    held_out = fold(F.col("doc_id"), 3, 1)
    detector = toxicity.fit(docs.where(~held_out), table(spark, folder, "labels").where(~held_out))
    score = toxicity.probability(docs, detector, F.col("text")).alias("score")
    scored = docs.select("doc_id", held_out.alias("held_out"), score)
    return scored.withColumn("predicted", (F.col("score") >= toxicity.LIMIT).cast("int"))


@query
def op10_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    held_out = fold(F.col("doc_id"), 4, 2)
    model = language.fit(docs.where(~held_out))
    found = docs.select("doc_id", held_out.alias("held_out"), language.identify(docs, model).alias("found"))
    return found.select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"))


@query
def op5_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    rows = fingerprints.with_next(table(spark, folder, "documents"))
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprints.shown(F.col("vec")).alias("fingerprint"),
        fingerprints.shown(F.col("edited_vec")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


@query
def op8_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    counted = token_counts.count_tokens(table(spark, folder, "documents"), PIECES)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


@query
def op9_mixing(spark: SparkSession, folder: str) -> DataFrame:
    kept = mixing.mix(table(spark, folder, "documents").select("doc_id", "text", "source", "lang"))
    return kept.select(
        "doc_id",
        *(F.col(f"mixing.{d}").alias(d) for d in mixing.TARGETS),
        F.col("mixing.tokens").cast("long").alias("n_tokens"),
        F.round("mixing.probability", 6).alias("probability"),
        F.round("mixing.weight", 6).alias("weight"),
    )


ORACLES["op9_mixing"] = mixing.sql(mixing.TARGETS, mixing.RATE, mixing.SWEEPS)


@query
def op7_repeats(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    cut = repeats.without_repeats(docs)
    return cut.select(
        "doc_id", "cut.n_bytes", "cut.n_removed", "cut.n_spans", F.sha2(F.col("cut.kept"), 256).alias("kept_sha256")
    )


@query
def op3_pivot_search(spark: SparkSession, folder: str) -> DataFrame:
    return pivot_search.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


@query
def op4_templates(spark: SparkSession, folder: str) -> DataFrame:
    pages = templates.extract(table(spark, folder, "pages"))
    size = F.char_length("main_text").cast("long").alias("n_chars")
    return pages.select("page_id", "url", F.col("main_text").alias("text"), size)


@query
def op11_repair(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations")
    fixed = conversations.repair(conversations.damaged(rows))
    whole = fixed.messages.groupBy("key").agg(F.max_by("digest", "step").alias("repaired_sha256"))
    ids = rows.select("conv_id", group_key(F.col("conv_id")).alias("key")).distinct()
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    found = ids.join(fixed.conversations.drop("conv_id"), "key", "left").join(whole, "key", "left")
    return found.select(
        "conv_id",
        *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


ORACLES["op11_repair"] = conversations.SQL


@query
def op12_warc(spark: SparkSession, folder: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write(table(spark, folder, "pages"), path)
    found = warc.read(spark, path, payloads=False)
    sound = F.coalesce(F.raise_error(F.concat_ws(": ", "archive", "problem")), F.lit(False))
    return found.where(F.when(F.col("problem").isNotNull(), sound).otherwise(True)).select(
        warc.page_of(F.col("record_id")).cast("long").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        warc.page_of(F.col("refers_to")).cast("long").alias("refers_to"),
    )


ORACLES["op12_warc"] = f"""WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS digest, strlen(coalesce(html, '')) AS n FROM pages),
    f AS (SELECT *, CASE WHEN n >= {warc.LEAST} THEN max(page_id) OVER (PARTITION BY digest, n) END AS o FROM p)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
    CASE WHEN o IS NOT NULL AND page_id IS DISTINCT FROM o THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN page_id IS DISTINCT FROM o THEN o END AS refers_to FROM f"""


@query
def op13_merkle(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    head = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    other = F.when(touched, merkle.leaf(*head, F.translate("text", merkle.UPPER, merkle.LOWER)))
    keep = F.struct("doc_id", other.alias("other"))
    rows = merkle.manifest(docs, merkle.leaf(*head, F.col("text")), F.col("lang"), F.col("doc_id"), keep)
    rows = rows.withColumn("folded_root", merkle.fold(F.coalesce("keep.other", "leaf"), F.col("path")))
    return rows.select(
        "keep.doc_id",
        "leaf",
        "subroot",
        "root",
        merkle.proof(F.col("path")).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


ORACLES["op13_merkle"] = merkle.SQL.format(crc=crc32_sql("doc_id::VARCHAR"), upper=merkle.UPPER, lower=merkle.LOWER)
