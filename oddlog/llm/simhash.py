"""SimHash near-duplicates: an inverted index on positional bytes with count filtering.

Two 64-bit fingerprints that differ in at most four bits agree in at least four of their eight bytes. The index lists
fingerprints by the bytes they hold at given positions. Among three groups of positions (0 1 2, 3 4 5, 6 7), four shared
positions put two into one group, so seven lists, each keyed by two bytes, bring every such pair together. Within a list
the shared positional bytes of a pair are tallied, pairs with at least four are retained, and their bits are counted.

Equal fingerprints are one entry of the index, so copies cost nothing. A list longer than ``LONGEST`` is not compared
but keyed further: by one more of five free bytes (of which a true pair shares one, as four of eight are shared), and
from four bytes on by one of five parts of the free bits (four differing bits leave one part equal). A list then holds
at most 2 ** (free bits) fingerprints, so this ends, without dropping a pair. What a list yields is a spanning forest
of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import slices, stage, text_batches
from .components import components

WIDTH = 4
SEED = 42
DISTANCE = 4
SHARED = 8 - DISTANCE  # bytes that a linked pair has in common at least
LONGEST = 1024  # fingerprints compared with each other in one list
CHUNK = 1 << 16
GROUPS = ((0, 1, 2), (3, 4, 5), (6, 7))


def bits(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits set."""
    spread = np.unpackbits(hashes.astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
    return spread.sum(axis=0, dtype=np.int64)


def fingerprint_of(text: str, width: int = WIDTH, seed: int = SEED) -> int:
    """The 64 bits, as a signed number, that over half the shingle hashes of a text have set.

    Words are what lies between ASCII white space after lower-casing A-Z; a text of fewer than ``width`` words is one
    shingle, a text without words has fingerprint 0. Hashes are tallied in portions, so a long text needs no more room.
    """
    words = text.encode().lower().split()
    if not words:
        return 0
    count = max(1, len(words) - width + 1)
    hashed = partial(xxhash.xxh64_intdigest, seed=seed)
    tally = np.zeros(64, np.int64)
    for start in range(0, count, CHUNK):
        part = words[start : start + CHUNK + width - 1]
        shingles = zip(*(part[i:] for i in range(width))) if len(part) >= width else [part]
        tally += bits(np.fromiter(map(hashed, map(b" ".join, shingles)), np.uint64))
    value = int(np.packbits(2 * tally > count, bitorder="little").view("<u8")[0])
    return value - (1 << 64) if value >> 63 else value


def fingerprint(text: Column, width: int = WIDTH, seed: int = SEED) -> Column:
    """The SimHash of a text column (long); null is taken as empty."""

    @F.arrow_udf("long")
    def simhash(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint_of(t, width, seed) for part in slices(texts) for t in part], pa.int64())

    return simhash(text)


def hex16(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def first_masks() -> list[int]:
    """The bits of two byte positions of one group."""
    return [255 << 8 * a | 255 << 8 * b for group in GROUPS for a in group for b in group if a < b]


def finer(mask: int) -> list[int]:
    """Masks that key a list more finely; every true pair of the list agrees on one of them."""
    free = [p for p in range(8) if not mask >> 8 * p & 1]
    whole = all((mask >> 8 * p & 255) in (0, 255) for p in range(8))
    if whole and 8 - len(free) < SHARED:
        return [mask | 255 << 8 * p for p in free[: DISTANCE + 1]]
    open_bits = [b for b in range(64) if not mask >> b & 1]
    return [mask | sum(1 << b for b in open_bits[part :: DISTANCE + 1]) for part in range(DISTANCE + 1)]


def forest(fps: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For rows sorted by list, where a row's list ends at ``ends``: the first row that each row is linked to in turn."""
    root = np.arange(len(fps))
    left, right, held = [], [], 0

    def unite():
        nonlocal root, held
        if held:
            a, b = np.concatenate(left), np.concatenate(right)
            while True:
                low = np.minimum(root[a], root[b])
                new = root.copy()
                np.minimum.at(new, root[a], low)
                np.minimum.at(new, root[b], low)
                while not np.array_equal(new, new[new]):
                    new = new[new]
                if np.array_equal(new, root):
                    break
                root = new
            left.clear()
            right.clear()
            held = 0

    rows = np.arange(len(fps))
    for step in range(1, len(fps)):
        rows = rows[rows + step < ends[rows]]
        if not len(rows):
            break
        apart = fps[rows] ^ fps[rows + step]
        shared = (apart.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
        near = np.flatnonzero(shared >= SHARED)
        near = near[np.bitwise_count(apart[near].astype(np.uint64)) <= DISTANCE]
        if len(near):
            left.append(rows[near])
            right.append(rows[near] + step)
            held += len(near)
            if held > 1 << 20:
                unite()
    unite()
    return root


def link_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within lists; rows come sorted by list. The last list of a batch waits for the next batch."""

    def linked(mask, value, fp, node):
        fresh = np.ones(len(fp), bool)
        fresh[1:] = (mask[1:] != mask[:-1]) | (value[1:] != value[:-1])
        starts = np.flatnonzero(fresh)
        ends = np.append(starts[1:], len(fp))
        root = forest(fp, np.repeat(ends, ends - starts))
        found = np.flatnonzero(root != np.arange(len(fp)))
        return pa.RecordBatch.from_arrays([pa.array(node[found]), pa.array(node[root[found]])], names=["a", "b"])

    held = None
    for batch in batches:
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
        if held is not None:
            columns = [np.concatenate(pair) for pair in zip(held, columns)]
        mask, value = columns[:2]
        if not len(mask):
            continue
        last = np.flatnonzero((mask != mask[-1]) | (value != value[-1]))
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:
            yield linked(*(c[:cut] for c in columns))
        held = [c[cut:] for c in columns]
    if held is not None and len(held[0]):
        yield linked(*held)


def links(nodes: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(a, b): links that connect all ``nodes`` (fp, node; each fp once) within ``DISTANCE`` bits of one another."""
    spark = nodes.sparkSession
    masks = first_masks()
    lists = nodes.withColumn("mask", F.explode(F.array(*(F.lit(signed(m)) for m in masks))))
    found = []
    while True:
        lists = lists.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("value"), "fp", "node")
        long = stage(lists.groupBy("mask", "value").count().where(F.col("count") > longest), "long").drop("count")
        more = not long.isEmpty()
        short = lists.join(long, ["mask", "value"], "left_anti") if more else lists
        dealt = short.repartition("mask", "value").sortWithinPartitions("mask", "value")
        found.append(stage(dealt.mapInArrow(link_lists, "a long, b long"), "links"))
        if not more:
            break
        # masks are made by rule, at most five times as many per level: a small table, whatever the input
        open_masks = {row["mask"] for row in long.select("mask").distinct().collect()}
        masks = [m for m in masks if signed(m) in open_masks]
        steps = [(signed(m), signed(child)) for m in masks for child in finer(m)]
        below = spark.createDataFrame(steps, "mask long, child long")
        finer_lists = lists.join(long, ["mask", "value"], "left_semi").join(F.broadcast(below), "mask")
        lists = stage(finer_lists.select(F.col("child").alias("mask"), "fp", "node").distinct(), "lists")
        masks = sorted({child for m in masks for child in finer(m)})
    out = found[0]
    for part in found[1:]:
        out = out.union(part)
    return out


def near_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, seed: int = SEED
) -> DataFrame:
    """(doc_id, fp, component_id) of every row: the smallest id that is reachable over links, its own included.

    Null and empty texts have fingerprint 0 and are linked like any other. Rows that share an id keep a row each and
    count as linked. A row whose id is null forms no links; it is in the component of its fingerprint, or of none (null)
    if no row with an id has that one.
    """
    text_batches(docs.sparkSession)
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    marked = stage(read.select("doc_id", fingerprint(F.col("text"), width, seed).alias("fp")), "fingerprints")
    nodes = marked.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node"))
    nodes = stage(nodes, "nodes")
    groups = components(links(nodes))
    labels = nodes.join(groups, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return marked.join(labels, "fp", "left").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near-duplicates: the one whose id names the component.

    Of rows that share this id, one stays. Of rows without an id, one per fingerprint stays, if no row with an id has
    that fingerprint.
    """
    groups = stage(near_groups(docs, id_col, text_col), "groups")
    named = groups.where("doc_id = component_id").select(F.col("doc_id").alias(id_col)).distinct()
    kept = docs.where(F.col(id_col).isNotNull()).join(named, id_col, "left_semi").dropDuplicates([id_col])
    marked = docs.where(F.col(id_col).isNull()).withColumn("simhash_of_row", fingerprint(F.col(text_col)))
    taken = groups.where("component_id is not null").select(F.col("fp").alias("simhash_of_row")).distinct()
    rest = marked.dropDuplicates(["simhash_of_row"]).join(taken, "simhash_of_row", "left_anti")
    return kept.select(*docs.columns).unionByName(rest.select(*docs.columns))
