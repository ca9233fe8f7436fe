import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from oddlog.llm import merkle
from oddlog.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, path string, digest int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(digests):
    """The root, and of every node its siblings (left, right) from level to level."""
    paths = [[] for _ in digests]
    at = [i for i in range(len(digests))]
    while len(digests) > 1:
        for i, place in enumerate(at):
            run = place - place % 8
            paths[i].append(("".join(digests[run:place]), "".join(digests[place + 1 : run + 8])))
            at[i] = place // 8
        digests = [h(*digests[i : i + 8]) for i in range(0, len(digests), 8)]
    return digests[0], paths


def brute(rows):
    groups = {}
    for doc_id, text, lang, source, n_chars in rows:
        head = [field(v) for v in (doc_id, source, lang, n_chars)]
        leaf = h(*head, field(text))
        touched = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0
        low = text and "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        groups.setdefault(lang, []).append((doc_id is not None, doc_id or 0, leaf, h(*head, field(low)) if touched else leaf, doc_id))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for name in names:
        groups[name].sort()
        trees[name] = tree([g[2] for g in groups[name]])
    root, above = tree([trees[name][0] for name in names])
    out = []
    for j, name in enumerate(names):
        subroot, paths = trees[name]
        for (_, _, leaf, seen, doc_id), path in zip(groups[name], paths):
            node = seen
            for left, right in path + above[j]:
                node = h(left, node, right)
            out.append((doc_id, leaf, subroot, root, h(*(x for pair in path + above[j] for x in pair)), node, node == root))
    return sorted(out, key=repr)


def asked(spark, tmp_path, rows):
    docs = spark.createDataFrame([(*r, "a path", 5) for r in rows], SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    return sorted(map(tuple, QUERIES["op13_merkle"](spark, str(tmp_path)).collect()), key=repr)


def sample(n, langs, seed=3):
    rng = random.Random(seed)
    return [(i, "".join(rng.choice("aBé X.") for _ in range(rng.randint(0, 30))), rng.choice(langs), rng.choice(["s", None]), rng.randint(0, 9)) for i in range(n)]


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65, 600])
def test_one_group_of_many_sizes(spark, tmp_path, n):
    rows = sample(n, ["en"])
    assert asked(spark, tmp_path, rows) == brute(rows)


def test_many_groups_nulls_empty_long_and_repeated_rows(spark, tmp_path):
    rows = sample(200, [None, "", "en", "é", "zz", "Z", *(f"l{i}" for i in range(12))])
    rows += [(None, None, None, None, None), (None, "", "", "", 0), (7, "x" * 300_000, "en", None, 1), rows[5], rows[5], (9, None, "en", "s", None)]
    assert asked(spark, tmp_path, rows) == brute(rows)


def test_several_rounds_of_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", 1)
    monkeypatch.setattr(merkle, "BLOCK", 8)
    rows = sample(700, ["en", "en", "en", "de", None])
    assert asked(spark, tmp_path, rows) == brute(rows)


def test_empty_table_and_tampering(spark, tmp_path):
    assert asked(spark, tmp_path, []) == []
    rows = spark.createDataFrame([(i, f"text {i}") for i in range(30)], "id long, text string")
    built = merkle.manifest(rows, merkle.leaf(F.col("text")), F.lit("all"), F.col("id"), F.col("id"))
    other = F.when(F.col("keep") == 11, merkle.leaf(F.lit("text 12"))).otherwise(F.col("leaf"))
    wrong = built.where(merkle.fold(other, F.col("path")) != F.col("root"))
    assert [r.keep for r in wrong.collect()] == [11]
