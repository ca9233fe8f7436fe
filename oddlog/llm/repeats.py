"""Exact substring de-duplication with a sampled, enhanced suffix array.

A byte goes if some string of ``LENGTH`` bytes that covers it starts anywhere else too, in another text or the same one.

* Anchors. In every window of LENGTH bytes the k-gram with the least hash (the rightmost of equals) is an anchor, about
  one position in 80. Equal windows have equal anchors at equal offsets, so a repeat is found among the occurrences of
  one anchor string, looking at most LENGTH bytes to the right and LENGTH - K to the left of each: its context.
* Occurrences with one and the same context are counted, not compared: each repeats all of its context.
* The different contexts of an anchor are the suffix array of that anchor: sorted by what follows, with the lengths of
  the common prefixes of neighbours. A stack scan visits the common-prefix intervals from the deepest up. An interval
  keeps its members in order of what precedes them, and is joined to the next one member by member, the smaller into the
  larger. Members that become neighbours in that order share the longest left extension; if it and the prefix make up
  LENGTH bytes, they repeat. So each member learns how far it is repeated to the left and to the right, at
  O(m log m) comparisons and without looking at pairs. The largest interval whose members all share LENGTH bytes, with
  the left extension at which they part (their left diversity), is a maximal repeat with all its occurrences.
* An anchor with more than ``MOST`` different contexts is counted window by window instead (161 rows a context, summed
  before the shuffle), which gives the same lengths without bringing the contexts together.

Only anchors that occur twice leave the first counting. Hashes have 64 bits within one anchor string, contexts are
compared byte by byte. Null texts are empty; texts shorter than LENGTH are kept as they are.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import nested, released, slices, stage, text_batches, unnested

LENGTH = 200
GRAM = 40
MOST = 100_000
PIECE = 1 << 20  # bytes of a text that are scanned at once
PLACE = (1 << 24) - 1
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


class Powers:
    """Powers of the base of the rolling hash and of its inverse, modulo 2**64."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            factors = np.ones((2, n), np.uint64)
            factors[:, 1:] = np.array([[BASE], [INVERSE]], np.uint64)
            cls.up, cls.down = np.cumprod(factors, axis=1, dtype=np.uint64)
        return cls.up[:n], cls.down[:n]


def least(keys: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` neighbours, by minima from block ends."""
    blocks = -(-len(keys) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(keys)] = keys
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    count = len(keys) - width + 1
    return np.minimum(behind[:count], ahead[width - 1 : width - 1 + count])


def anchors_of(data: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Positions and k-gram hashes of the anchors of a text."""
    places, hashes = [], []
    for start in range(0, max(len(data) - length + 1, 0), PIECE):
        part = np.frombuffer(data[start : start + PIECE + length - 1], np.uint8)
        up, down = Powers.of(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=sums[1:])
        h = (sums[gram:] - sums[:-gram]) * down[: len(part) - gram + 1]
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        place = np.arange(len(h), dtype=np.uint64)
        keys = (h & ~np.uint64(PLACE)) | (np.uint64(PLACE) - place)
        found = (np.uint64(PLACE) - (least(keys, length - gram + 1) & np.uint64(PLACE))).astype(np.int64)
        found = found[np.concatenate([[True], found[1:] != found[:-1]])]
        places.append(found + start)
        hashes.append(h[found])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    place, h = np.concatenate(places), np.concatenate(hashes)
    fresh = np.concatenate([[True], place[1:] != place[:-1]])
    return place[fresh], h[fresh]


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    apart = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (apart.bit_length() + 7) // 8


def extents(lefts: list[bytes], rights: list[bytes], length: int = LENGTH):
    """How far each context is repeated, and the largest maximal repeat it is in.

    ``lefts`` are read backwards from the anchor, ``rights`` forwards. Returns left and right extents (0 0 if it is not
    repeated) and, per context, (group, bytes to the left, length) or None.
    """
    m = len(rights)
    left_of, right_of = [0] * m, [0] * m
    groups: list[tuple[int, int, int] | None] = [None] * m
    by_left = sorted(range(m), key=lefts.__getitem__)
    rank = [0] * m
    for place, member in enumerate(by_left):
        rank[member] = place

    def meet(a: int, b: int, prefix: int) -> None:
        shared = common(lefts[a], lefts[b])
        if shared + prefix >= length:
            for member in (a, b):
                left_of[member] = max(left_of[member], shared)
                right_of[member] = max(right_of[member], prefix)

    def join(prefix: int) -> None:
        """Join the last two intervals; ``prefix`` is what their members have in common."""
        small, large = parts.pop(), parts.pop()
        if len(small) > len(large):
            small, large = large, small
        for place in small:
            at = bisect_left(large, place)
            if at:
                meet(by_left[large[at - 1]], by_left[place], prefix)
            if at < len(large):
                meet(by_left[place], by_left[large[at]], prefix)
            large.insert(at, place)
        parts.append(large)

    def closed(prefix: int) -> None:
        """An interval is complete: note its repeat if all members share it."""
        whole = parts[-1]
        left = common(lefts[by_left[whole[0]]], lefts[by_left[whole[-1]]])
        if left + prefix >= length:
            spans.append((len(whole), prefix, left, scanned))

    order = sorted(range(m), key=rights.__getitem__)
    parts, gaps = [[rank[order[0]]]], []
    spans: list[tuple[int, int, int, int]] = []
    scanned = 1
    for before, member in zip(order, order[1:]):
        gap = common(rights[before], rights[member])
        while gaps and gaps[-1] >= gap:
            depth = gaps.pop()
            join(depth)
            if not gaps or gaps[-1] < depth:
                if depth > gap:
                    closed(depth)
        gaps.append(gap)
        parts.append([rank[member]])
        scanned += 1
    while gaps:
        depth = gaps.pop()
        join(depth)
        if not gaps or gaps[-1] < depth:
            closed(depth)
    # Intervals are noted from the deepest up, so a later one that covers a member is larger and replaces its group.
    free = m
    for size, prefix, left, end in reversed(spans):
        if end <= free:
            for member in order[end - size : end]:
                groups[member] = (end - size, left, left + prefix)
            free = end - size
    return left_of, right_of, groups


def anchor_rows(length: int, gram: int):
    """(uid, at, gram, context) of every anchor; ``at`` packs the position and the context's bytes to the right."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            uids = batch.column(0).to_numpy(zero_copy_only=False)
            done = 0
            for part in slices(batch.column(1)):
                out = [[], [], [], []]
                for uid, text in zip(uids[done : done + len(part)].tolist(), part):
                    data = text.encode()
                    place, h = anchors_of(data, length, gram)
                    if not len(place):
                        continue
                    lows = np.maximum(place - (length - gram), 0)
                    spots, low = place.tolist(), lows.tolist()
                    contexts = [digest(data[a : p + length], p - a) for a, p in zip(low, spots)]
                    out[0].append(np.full(len(place), uid, np.int64))
                    out[1].append(place << 16 | np.minimum(len(data) - place, length))
                    out[2].append(h.view(np.int64))
                    out[3].append(np.array(contexts, np.uint64).view(np.int64))
                done += len(part)
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["uid", "at", "gram", "context"])

    return rows


def context_rows(length: int, gram: int):
    """(gram, context, n, left, bytes) for the anchors that a text (text, wanted) is asked for."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["gram", "context", "left", "bytes"]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        for batch in batches:
            asked = batch.column(1).to_pylist()
            done = 0
            for part in slices(batch.column(0)):
                out: list[list] = [[], [], [], []]
                for text, wanted in zip(part, asked[done : done + len(part)]):
                    data = text.encode()
                    for w in wanted:
                        place = w["at"] >> 16
                        low = max(place - (length - gram), 0)
                        for column, value in zip(out, (w["gram"], w["context"], place - low, data[low : place + length])):
                            column.append(value)
                done += len(part)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)

    return rows


def interval_rows(length: int):
    """Extents and groups of the contexts of each anchor string; rows come sorted by it."""

    def finished(grams, contexts, lefts, data):
        out = [[], [], [], [], [], [], []]
        bounds = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1], [True]])).tolist()
        for first, end in zip(bounds, bounds[1:]):
            if end - first < 2:
                continue
            before = [d[:n][::-1] for d, n in zip(data[first:end], lefts[first:end])]
            after = [d[n:] for d, n in zip(data[first:end], lefts[first:end])]
            left, right, groups = extents(before, after, length)
            for i in range(end - first):
                if left[i] + right[i]:
                    group = groups[i] or (None, None, None)
                    for column, value in zip(out, (int(grams[first]), int(contexts[first + i]), left[i], right[i], *group)):
                        column.append(value)
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
        names = ["gram", "context", "left", "right", "part", "part_left", "part_length"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, contexts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        lefts: list[int] = []
        data: list[bytes] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            grams = np.concatenate([grams, batch.column(0).to_numpy()])
            contexts = np.concatenate([contexts, batch.column(1).to_numpy()])
            lefts += batch.column(2).to_pylist()
            data += batch.column(3).to_pylist()
            cut = int(np.searchsorted(grams, grams[-1]))  # the last anchor may go on in the next batch
            if cut:
                yield finished(grams[:cut], contexts[:cut], lefts[:cut], data[:cut])
                grams, contexts, lefts, data = grams[cut:], contexts[cut:], lefts[cut:], data[cut:]
        if len(grams):
            yield finished(grams, contexts, lefts, data)

    return rows


def window_rows(length: int, gram: int):
    """(gram, context, left, window): every window of a context by its bytes left of the anchor."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            columns = (batch.column(i).to_pylist() for i in range(4))
            for g, context, left, data in zip(*columns):
                found = [(o, digest(data[left - o : left - o + length])) for o in range(left + 1) if left - o + length <= len(data)]
                if found:
                    kept, digests = zip(*found)
                    arrays = [pa.array([g] * len(kept)), pa.array([context] * len(kept)), pa.array(kept, pa.int32()), pa.array(digests)]
                    yield pa.RecordBatch.from_arrays(arrays, names=["gram", "context", "left", "window"])

    return rows


def windows_counted(contexts: DataFrame, length: int, gram: int) -> DataFrame:
    """Extents of contexts from the windows they share with another context of their anchor."""
    rows = stage(contexts.mapInArrow(window_rows(length, gram), "gram long, context long, left int, window binary"), "windows")
    twice = rows.groupBy("gram", "left", "window").count().where("count > 1").drop("count")
    shared = rows.join(twice, ["gram", "left", "window"])
    return shared.groupBy("gram", "context").agg(F.max("left").alias("left"), (length - F.min("left")).alias("right"))


def with_uid(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, bool]:
    """``docs`` with ``uid``, the id if ids are unique and otherwise a hash of id and text; and whether they are.

    Rows that are equal in both share a uid, and get equal results.
    """
    ids = docs.select(F.col(id_col).cast("long").alias("id"))
    unclear = ids.where("id is null").unionByName(ids.groupBy("id").count().where("count > 1").select("id"))
    unique = unclear.isEmpty()
    key = F.col(id_col).cast("long")
    uid = key if unique else F.xxhash64(key, F.coalesce(F.col(text_col), F.lit("")))
    return docs.withColumn("uid", uid), unique


def extents_of(docs: DataFrame, unique: bool, length: int, gram: int, most: int) -> tuple[DataFrame, DataFrame]:
    """For ``docs`` (uid, text): repeated anchors (uid, at, gram, context), and the extents of repeated contexts."""
    text_batches(docs.sparkSession)
    found = stage(docs.mapInArrow(anchor_rows(length, gram), "uid long, at long, gram long, context long"), "anchors")
    counts = found.groupBy("gram").agg(F.count("*").alias("n"), (F.min("context") != F.max("context")).alias("several"))
    counts = stage(counts.where("n > 1").select("gram", "several"), "grams")  # staged, so that the join can split hot ones
    repeated = stage(found.join(counts, "gram"), "repeated")
    one = F.min(F.struct("uid", "at")).alias("one")
    contexts = stage(repeated.groupBy("gram", "context", "several").agg(F.count("*").alias("n"), one), "contexts")
    place, right = F.shiftright("one.at", 16), F.col("one.at").bitwiseAND(0xFFFF).cast("int")
    left = F.least(place, F.lit(length - gram)).cast("int")
    nothing = [F.lit(None).cast("int").alias(c) for c in ("part", "part_left", "part_length")]
    same = contexts.where((F.col("n") > 1) & (left + right >= length))
    same = same.select("gram", "context", left.alias("left"), right.alias("right"), *nothing)
    wanted = F.struct(F.col("one.at").alias("at"), "gram", "context").alias("w")
    asked = contexts.where("several").select(F.col("one.uid").alias("uid"), wanted)
    asked = asked.groupBy("uid").agg(F.collect_list("w").alias("wanted"))  # at most the anchors of one text
    texts = docs if unique else docs.groupBy("uid").agg(F.first("text").alias("text"))
    bytes_of = texts.join(asked, "uid").select("text", "wanted")
    bytes_of = bytes_of.mapInArrow(context_rows(length, gram), "gram long, context long, left int, bytes binary")
    big = stage(contexts.where("several").groupBy("gram").count().where(F.col("count") > most).select("gram"), "big")
    schema = "gram long, context long, left int, right int, part int, part_left int, part_length int"
    more = not big.isEmpty()
    if more:
        bytes_of = stage(bytes_of, "bytes")
    small = bytes_of.join(big, "gram", "left_anti") if more else bytes_of
    dealt = small.repartition("gram").sortWithinPartitions("gram")
    extents = same.unionByName(dealt.mapInArrow(interval_rows(length), schema))
    if more:
        counted = windows_counted(bytes_of.join(big, "gram", "left_semi"), length, gram)
        extents = extents.unionByName(counted.select("*", *nothing))
    extents = extents.groupBy("gram", "context").agg(
        F.max("left").alias("left"),
        F.max("right").alias("right"),
        F.max(F.struct("part_length", "part_left", "part")).alias("group"),
    )
    return repeated, stage(extents, "extents")


def spans(docs: DataFrame, unique: bool, length: int = LENGTH, gram: int = GRAM, most: int = MOST) -> DataFrame:
    """(uid, spans) of ``docs`` (uid, text): repeated stretches (start, end in bytes) of each text that has any.

    They are in no order and may overlap.
    """
    repeated, extents = extents_of(docs, unique, length, gram, most)
    place = F.shiftright("at", 16)
    hits = repeated.join(extents, ["gram", "context"])
    span = F.struct((place - F.col("left")).alias("start"), (place + F.col("right")).alias("end"))
    return hits.groupBy("uid").agg(F.collect_list(span).alias("spans"))


def repeat_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, most: int = MOST
) -> DataFrame:
    """Maximal repeats with all their occurrences: (repeat, length, doc_id, start).

    Each anchor occurrence is listed once, under the most widely shared maximal repeat that it is in.
    """
    keyed, unique = with_uid(docs, id_col, text_col)
    keyed = keyed.select("uid", F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    repeated, extents = extents_of(keyed.select("uid", "text"), unique, length, gram, most)
    whole = F.col("group.part").isNull()
    hits = repeated.join(extents, ["gram", "context"])
    hits = hits.select(
        F.when(whole, F.xxhash64("gram", "context"))
        .otherwise(F.xxhash64("gram", "group.part", "group.part_length"))
        .alias("repeat"),
        F.when(whole, F.col("left") + F.col("right")).otherwise(F.col("group.part_length")).alias("length"),
        "uid",
        (F.shiftright("at", 16) - F.when(whole, F.col("left")).otherwise(F.col("group.part_left"))).alias("start"),
    )
    return hits.join(keyed.select("uid", "doc_id").distinct(), "uid").select("repeat", "length", "doc_id", "start")


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping and touching stretches as maximal runs."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    fresh = np.concatenate([[True], starts[1:] > reach[:-1]])
    return starts[fresh], reach[np.concatenate([np.flatnonzero(fresh)[1:] - 1, [len(starts) - 1]])]


def cut_out(as_text: bool):
    """A function from texts and their stretches to what is left: bytes, or text without broken characters."""

    def cut(texts: pa.Array, found: pa.Array) -> pa.Array:
        out = []
        at = 0
        for part in slices(texts):
            for text in part:
                data, stretch = text.encode(), found[at].values
                at += 1
                kept, removed = data, 0
                if stretch is not None and len(stretch):
                    starts, ends = merged(*(stretch.field(i).to_numpy(zero_copy_only=False) for i in (0, 1)))
                    edges = [0, *np.stack([starts, ends], axis=1).ravel().tolist(), len(data)]
                    kept, removed = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])), len(starts)
                row = {"n_bytes": len(data), "n_removed": len(data) - len(kept), "n_spans": removed}
                out.append(row | {"kept": kept.decode("utf-8", "ignore") if as_text else kept})
        kinds = [("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64())]
        return pa.array(out, pa.struct([*kinds, ("kept", pa.string() if as_text else pa.binary())]))

    kind = "string" if as_text else "binary"
    return F.arrow_udf(cut, f"n_bytes long, n_removed long, n_spans long, kept {kind}")


def without_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    gram: int = GRAM,
    most: int = MOST,
    as_text: bool = False,
) -> DataFrame:
    """``docs`` with a struct ``cut``: n_bytes, n_removed, n_spans (maximal removed runs) and the kept bytes.

    With ``as_text``, ``kept`` is text; characters of which a repeat has taken some bytes are left out.

    Every occurrence of a repeat is removed, judged on the texts as they came in. A column ``cut`` is replaced.
    """
    rows = docs.select(nested(docs), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    keyed, unique = with_uid(rows, "id", "text")
    with released(docs.sparkSession):
        found = stage(spans(keyed.select("uid", "text"), unique, length, gram, most), "spans")
    joined = keyed.join(found, "uid", "left")
    return unnested(joined.select("row", cut_out(as_text)(F.col("text"), F.col("spans")).alias("cut")), docs.columns, "cut")
