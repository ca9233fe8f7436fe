import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from oddlog.llm import simhash
from oddlog.llm.components import components

xxhash = pytest.importorskip("xxhash")


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_groups(values):
    """Smallest index reachable within four bits, by comparing all pairs."""
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= 4) + i + 1:
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_fingerprint(monkeypatch):
    texts = ["", " \t\n", "one", "A b c", "a B c d e", "é x y\x1cz  w v\nu", "w " * 70 + "end", "Ü ä"]
    for text in texts:
        assert simhash.fingerprint_of(text) % (1 << 64) == slow_fingerprint(text)
    long = " ".join(f"w{i % 97}" for i in range(1000))
    whole = simhash.fingerprint_of(long)
    monkeypatch.setattr(simhash, "CHUNK", 100)
    assert simhash.fingerprint_of(long) == whole


def test_every_pair_meets_in_a_list():
    rng = random.Random(1)
    masks = simhash.first_masks()
    assert len(masks) == 7
    for level in range(5):
        for _ in range(300):
            a = b = rng.getrandbits(64)
            for bit in rng.sample(range(64), rng.randint(0, 4)):
                b ^= 1 << bit
            meeting = [m for m in masks if a & m == b & m]
            assert meeting and all(any(a & f == b & f for f in simhash.finer(m)) for m in meeting)
        masks = sorted({f for m in masks for f in simhash.finer(m)})


@pytest.mark.parametrize("longest", [1024, 24])
def test_links_connect_what_all_pairs_connect(spark, longest):
    rng = np.random.default_rng(3)
    values = list(rng.integers(0, 1 << 63, 60, dtype=np.uint64))
    for seed in values[:12]:
        at = int(seed)
        for _ in range(12):  # chains and clouds of near fingerprints
            for bit in rng.integers(0, 64, rng.integers(1, 5)):
                at ^= 1 << int(bit)
            values.append(np.uint64(at))
    values = np.unique(np.array(values, np.uint64))
    rng.shuffle(values)
    rows = [(int(v.astype(np.int64)), i) for i, v in enumerate(values)]
    nodes = spark.createDataFrame(rows, "fp long, node long").repartition(5)
    found = dict(components(simhash.links(nodes, longest)).collect())
    assert [found.get(i, i) for i in range(len(values))] == slow_groups(values)


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(300)]
    star = [(1000, 1000 + i) for i in range(1, 400)]
    links = spark.createDataFrame(chain + star + [(5, 5), (7, None)], "a long, b long").repartition(7)
    got = dict(components(links).collect())
    assert got == {**{i: 0 for i in range(1, 301)}, **{1000 + i: 1000 for i in range(1, 400)}}
    assert components(links.limit(0)).count() == 0


def test_groups_and_edge_rows(spark):
    base = " ".join(f"word{i}" for i in range(4000))
    near = base.replace("word150 ", "other ")
    assert bin(slow_fingerprint(base) ^ slow_fingerprint(near)).count("1") <= 4
    rows = [
        (5, base, "x"), (2, near, "x"), (9, base, "x"), (9, base, "x"), (None, base, None), (4, None, "y"), (3, "", "y"),
        (7, "quite another text of some words", "z"), (None, "text without an id that is nowhere else", None),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = simhash.near_groups(docs).collect()
    assert len(got) == len(rows)
    by_fp = {r.fp % (1 << 64): r.component_id for r in got}
    assert by_fp[slow_fingerprint(base)] == 2 and by_fp[0] == 3
    assert {r.component_id for r in got if r.doc_id is None} == {2, None}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or -1, r.text) for r in kept.collect()) == sorted(
        [(2, near), (3, ""), (7, rows[7][1]), (-1, rows[8][1])]
    )
    assert simhash.near_groups(docs.limit(0)).count() == 0
    shown = spark.range(1).select(simhash.hex16(F.lit(-1)), simhash.hex16(F.lit(255))).first()
    assert tuple(shown) == ("f" * 16, "0" * 14 + "ff")
