import random

import pytest

import corpus_pipeline
from oddlog.llm import near_copies, simhash

pytest.importorskip("xxhash")


def jaccard(a, b):
    a, b = (set(near_copies.shingles_of(t).tolist()) for t in (a, b))
    return len(a & b) / len(a | b)


def slow_groups(texts):
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if jaccard(texts[i], texts[j]) >= 0.8:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return root


def planted(rng):
    """Texts with edited copies on both sides of the bound, and families that share less."""
    texts = []
    for _ in range(30):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(30, 200))]
        texts.append(" ".join(words))
        for _ in range(rng.randint(0, 5)):
            edited = list(words)
            for at in rng.sample(range(len(words)), max(1, int(len(words) * rng.choice([0.01, 0.015, 0.02, 0.03, 0.08])))):
                edited[at] = f"x{rng.randrange(5000)}"
            texts.append(" ".join(edited))
            words = rng.choice([words, edited])
    return texts


@pytest.mark.parametrize("part", [512, 3])
def test_stage_keeps_one_of_each_group(spark, monkeypatch, part):
    monkeypatch.setattr(near_copies, "PART", part)
    monkeypatch.setattr(near_copies, "PIVOTS", 2)
    texts = planted(random.Random(part))
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, extra long").repartition(5)
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    root = slow_groups(texts)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(root)) and len(set(root)) < len(texts)


def test_edge_rows(spark):
    base = " ".join(f"word{i}" for i in range(400))
    near = base.replace("word150 ", "other ")
    rows = [(5, base), (2, near), (9, base), (None, near), (4, None), (3, " \n"), (None, ""), (7, "a b"), (8, "A  b"),
            (None, "on its own"), (None, "on its own"), (None, "On its own"), (11, "one text"), (11, "another text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = near_copies.keep_one(docs).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [2, 3, 7, 11]
    assert [r.text.lower() for r in kept if r.doc_id is None] == ["on its own"]
    assert near_copies.keep_one(docs.limit(0)).count() == 0


def test_a_share_of_the_whole_counts_not_the_bits():
    a = " ".join(f"w{i}" for i in range(205))
    b = a.replace("w50 ", "x ").replace("w90 ", "y ").replace("w130 ", "z ")
    assert 0.8 <= jaccard(a, b) < 0.9
    assert set(near_copies.keys_of(near_copies.shingles_of(a))) & set(near_copies.keys_of(near_copies.shingles_of(b)))


def test_the_stage_links_by_simhash_and_by_shares(spark):
    """Fingerprints within four bits link, whatever the shares; so do shares of 0.8, whatever the bits; and chains of both."""
    a = " ".join(f"w{i}" for i in range(300))
    versions = [" ".join(f"x{i}" if i % n == 5 else f"w{i}" for i in range(300)) for n in (290, 140, 100, 80, 60, 45, 35, 30, 25)]
    refrain = " ".join(f"r{i % 11}" for i in range(1000))
    songs = [refrain + "".join(f" {end}{i}" for i in range(20)) for end in "pq"]
    texts = [a, *versions, *songs]
    prints = [simhash.fingerprint_of(t) & (1 << 64) - 1 for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i)]
    near = {(i, j) for i, j in pairs if (prints[i] ^ prints[j]).bit_count() <= simhash.DISTANCE}
    alike = {(i, j) for i, j in pairs if jaccard(texts[i], texts[j]) >= 0.8}
    assert near - alike and alike - near
    root = list(range(len(texts)))
    for i, j in sorted(near | alike) * len(texts):
        low, high = sorted((root[i], root[j]))
        root = [low if r == high else r for r in root]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == sorted(set(root))
