"""The registered queries: all ten, their columns, and what SQL or held-out labels say about them."""

import os
import sys

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from oddlog.llm.queries import ORACLES, QUERIES

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.join(ROOT, "tools"))
FOLDER = "/root/testdata/sf0.001"
if not os.path.isdir(FOLDER):
    pytest.skip("no test tables", allow_module_level=True)

COLUMNS = {
    1: "doc_id n_tokens ids_sha256 decoded_sha256",
    2: "doc_id fingerprint component_id",
    3: "query_id rank vec_id score",
    4: "page_id url text n_chars",
    5: "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    6: "doc_id held_out score predicted",
    7: "doc_id n_bytes n_removed n_spans kept_sha256",
    8: "doc_id n_bytes n_tokens over_limit",
    9: "doc_id source lang topic n_tokens probability weight",
    10: "doc_id held_out lang_pred score",
    11: "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256",
    12: "page_id payload_bytes payload_digest record_type refers_to",
    13: "doc_id leaf subroot root proof_sha256 folded_root verified",
}


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == sorted(COLUMNS)
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("number", sorted(COLUMNS))
def test_columns_and_rows(spark, number):
    name = next(n for n in QUERIES if n.startswith(f"op{number}_"))
    df = QUERIES[name](spark, FOLDER)
    assert " ".join(df.columns) == COLUMNS[number]
    rows = df.count()
    tables = {3: "embeddings", 4: "pages", 12: "pages"}
    whole = spark.read.parquet(f"{FOLDER}/{tables.get(number, 'documents')}.parquet").count()
    assert rows == whole if number not in (3, 9, 11) else 0 < rows


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    import check_queries

    ok, message = check_queries.compare(name, QUERIES[name], ORACLES[name], spark, FOLDER)
    assert ok, message


def test_pipeline_keeps_columns_of_any_name(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names = ("cut", "language_found", "copy_of_row", "mixing", "row", "found", "whole")
    odd = docs.select("*", *(F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in names))
    for name, function in corpus_pipeline.STAGES[:-1]:
        odd = corpus_pipeline.stage(function(spark, odd, FOLDER), name)
        assert odd.columns == docs.columns + list(names)
        assert odd.where(" or ".join(f"{n} <> concat('{n}', doc_id)" for n in names)).count() == 0 < odd.count()


def test_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    extra = [(100_001, None), (100_002, "12 34 !!"), (100_003, ""), (None, None)]
    odd = spark.createDataFrame([(i, t, None, None, 0) for i, t in extra], docs.schema)
    sizes = []
    at = docs.union(odd)
    for name, function in corpus_pipeline.STAGES:
        after = corpus_pipeline.stage(function(spark, at, FOLDER), name)
        assert name == "byte_bpe" or after.columns == docs.columns
        sizes.append(after.count())
        if name == "language":
            assert after.where("doc_id > 100000 or doc_id is null").count() == 0 and sizes[0] == docs.count()
        if name == "near_duplicates":
            assert after.count() == after.select("doc_id").distinct().count() == after.select("text").distinct().count()
        at = after
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0
    assert at.where("not round_trip").count() == 0 and at.where(F.size("ids") != F.col("n_tokens")).count() == 0
    for name, function in corpus_pipeline.STAGES:
        assert function(spark, docs.limit(0), FOLDER).count() == 0
