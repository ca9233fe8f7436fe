import random
from collections import Counter

import pytest

from oddlog.llm import repeats


def slow_cover(texts, length):
    counts = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        covered = [False] * len(t)
        for i in range(len(t) - length + 1):
            if counts[t[i : i + length]] > 1:
                covered[i : i + length] = [True] * length
        out.append(covered)
    return out


def kept(texts, length):
    return [bytes(b for b, gone in zip(t, c) if not gone) for t, c in zip(texts, slow_cover(texts, length))]


def made_up(rng, letters, pieces, count):
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(pieces)]
    return [
        "".join(
            rng.choice(base)[rng.randint(0, 3) :] if rng.random() < 0.6 else "".join(rng.choice(letters) for _ in range(9))
            for _ in range(rng.randint(0, 4))
        )
        for _ in range(count)
    ]


@pytest.mark.parametrize("letters", ["ab", "abcdéß", "abcdefghijklmnop"])
@pytest.mark.parametrize("most", [100_000, 2])
def test_equals_counting_all_windows(spark, letters, most):
    rng = random.Random(len(letters) + most)
    texts = made_up(rng, letters, 6, 60)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = repeats.without_repeats(docs, length=12, gram=4, most=most)
    found = {r.doc_id: r.cut for r in got.collect()}
    raw = [t.encode() for t in texts]
    for i, want in enumerate(kept(raw, 12)):
        cut = found[i]
        assert bytes(cut.kept) == want and cut.n_bytes == len(raw[i]) and cut.n_removed == len(raw[i]) - len(want)
        covered = slow_cover(raw, 12)[i]
        assert cut.n_spans == sum(a and not b for a, b in zip(covered, [False, *covered]))


def test_groups_list_all_occurrences(spark):
    passage = "a passage that many documents share, word for word"
    texts = [f"{i * 37} before {passage} after {i * 91}" for i in range(9)] + ["nothing of the kind here at all, really"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    groups = repeats.repeat_groups(docs, length=20, gram=6).collect()
    by_repeat = {}
    for row in groups:
        text = texts[row.doc_id].encode()[row.start : row.start + row.length]
        assert len(text) == row.length >= 20
        by_repeat.setdefault(row["repeat"], []).append((row.doc_id, text))
    assert all(len({t for _, t in members}) == 1 for members in by_repeat.values())
    assert any({d for d, _ in members} == set(range(9)) for members in by_repeat.values())


def test_edge_rows(spark):
    line = "0123456789abcdefghij" * 15
    rows = [
        (1, line, "x"), (1, line, "x"), (None, line, None), (2, None, "y"), (3, "", "y"), (4, "short", None),
        (5, "ä" * 400, "z"), (6, line[:199] + "!" + line[200:], "z"), (7, "unlike " + "".join(map(chr, range(300, 700))), "q"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, uid string").withColumnRenamed("uid", "cut")
    got = repeats.without_repeats(docs)
    assert sorted(got.columns) == ["cut", "doc_id", "text"] and got.count() == len(rows)
    texts = [(r[1] or "").encode() for r in rows]
    want = Counter(zip([r[0] for r in rows], kept(texts, 200)))
    assert Counter((r.doc_id, bytes(r.cut.kept)) for r in got.collect()) == want
    named = docs.withColumnRenamed("cut", "uid")  # extra columns named like the operator's own stay
    as_text = repeats.without_repeats(named, as_text=True).collect()
    assert {r.uid for r in as_text} == {"x", "y", "z", "q", None} and all(isinstance(r.cut.kept, str) for r in as_text)
    assert repeats.without_repeats(docs.limit(0)).count() == 0


def test_long_text_is_scanned_in_pieces(monkeypatch):
    rng = random.Random(2)
    data = bytes(rng.randrange(256) for _ in range(5000))
    whole = repeats.anchors_of(data)
    monkeypatch.setattr(repeats, "PIECE", 700)
    pieces = repeats.anchors_of(data)
    assert whole[0].tolist() == pieces[0].tolist() and whole[1].tolist() == pieces[1].tolist()
    assert len(whole[0]) < 5000 / 40
