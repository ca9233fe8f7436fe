"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of at least ``LEAST``.

* Every text becomes the set of its shingle hashes. Equal sets are one node, so copies cost nothing.
* ``BANDS`` keys of ``ROWS`` min-hashes each bring similar sets together. A pair with similarity J shares no key with
  probability (1 - J ** ROWS) ** BANDS: 7e-10 at 0.8, less above. All nodes of a key are linked to its least node, and the
  components of these links are blocks: whatever is similar enough is in one block.
* Within a block, sets are compared exactly, and only pairs with at least ``LEAST`` are linked. A block with more than
  ``PART`` nodes is first compared with ``PIVOTS`` of its nodes; then it is dealt into parts, and each two parts are
  compared in a task of their own, unless both belong to the component that the pivots found. Nodes already linked are
  not compared again.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import nested, slices, stage, text_batches, unnested
from .components import components

WIDTH = 5
LEAST = 0.8
ROWS = 4
BANDS = 40
SEED = 42
PART = 512
PIVOTS = 16
CHUNK = 1 << 12

_random = np.random.default_rng(SEED)
FACTORS = _random.integers(0, 1 << 63, ROWS * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADDED = _random.integers(0, 1 << 63, ROWS * BANDS, dtype=np.uint64)


def shingles_of(text: str, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles.

    Words are what lies between ASCII white space after lower-casing A-Z; a text of fewer than ``width`` words is one
    shingle, a text without words has none.
    """
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    parts = zip(*(words[i:] for i in range(width))) if len(words) >= width else [words]
    hashed = partial(xxhash.xxh64_intdigest, seed=SEED)
    return np.unique(np.fromiter(map(hashed, map(b" ".join, parts)), np.uint64))


def node_of(shingles: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(shingles.tobytes(), SEED) - (1 << 63)


def keys_of(shingles: np.ndarray) -> np.ndarray:
    """One key per band, of its min-hashes; no keys for an empty set."""
    if not len(shingles):
        return np.zeros(0, np.int64)
    least = np.full(ROWS * BANDS, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(shingles), CHUNK):
        part = shingles[start : start + CHUNK]
        for at in range(0, len(FACTORS), ROWS):
            mixed = part[None, :] * FACTORS[at : at + ROWS, None] + ADDED[at : at + ROWS, None]
            least[at : at + ROWS] = np.minimum(least[at : at + ROWS], mixed.min(axis=1))
    bands = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(b.tobytes(), i) for i, b in enumerate(bands)], np.uint64).view(np.int64)


def sketch(text: Column) -> Column:
    """(node, keys) of a text column; null is taken as empty."""
    kind = pa.struct([("node", pa.int64()), ("keys", pa.list_(pa.int64()))])

    @F.arrow_udf("struct<node:long,keys:array<long>>")
    def sketched(texts: pa.Array) -> pa.Array:
        sets = (shingles_of(t) for part in slices(texts) for t in part)
        return pa.array([{"node": node_of(s), "keys": keys_of(s)} for s in sets], kind)

    return sketched(text)


def shingle_sets(text: Column) -> Column:
    @F.arrow_udf("array<long>")
    def sets(texts: pa.Array) -> pa.Array:
        return pa.array([shingles_of(t).view(np.int64) for part in slices(texts) for t in part], pa.list_(pa.int64()))

    return sets(text)


def similar(sets: list[np.ndarray], sides: np.ndarray, labels: np.ndarray) -> list[tuple[int, int]]:
    """Links (i, j) that connect all pairs of sets with at least ``LEAST``.

    Rows with equal labels are linked already. Pairs within a side need no comparing, unless the side is -1.
    """
    starts = np.cumsum([0] + [len(s) for s in sets])
    sizes = np.diff(starts)
    names, codes = np.unique(np.concatenate(sets), return_inverse=True)
    label = np.unique(labels, return_inverse=True)[1]
    marked = np.zeros(len(names), bool)
    found = []
    for i in range(len(sets)):
        apart = (label != label[i]) & ((sides != sides[i]) | (sides == -1))
        apart[: i + 1] = False
        alike = np.minimum(sizes, sizes[i]) >= LEAST * np.maximum(sizes, sizes[i])
        others = np.flatnonzero(apart & alike)
        if not len(others):
            continue
        mine = codes[starts[i] : starts[i + 1]]
        marked[mine] = True
        for j in others.tolist():
            if label[j] == label[i]:
                continue
            both = int(np.count_nonzero(marked[codes[starts[j] : starts[j + 1]]]))
            if both >= LEAST * (sizes[i] + sizes[j] - both) - 1e-9:
                found.append((i, j))
                label[label == label[j]] = label[i]
        marked[mine] = False
    return found


def link_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within tiles, from rows (block, tile, side, label, node, set) that come sorted by block and tile."""

    def linked(rows: list[tuple]) -> pa.RecordBatch:
        links = similar([r[5] for r in rows], np.array([r[2] for r in rows]), np.array([r[3] for r in rows]))
        ends = [[rows[pair[side]][4] for pair in links] for side in (0, 1)]
        return pa.RecordBatch.from_arrays([pa.array(e, pa.int64()) for e in ends], names=["a", "b"])

    held: list[tuple] = []
    for batch in batches:
        numbers = [batch.column(i).to_pylist() for i in range(5)]
        for at, row in enumerate(zip(*numbers)):
            if held and held[-1][:2] != row[:2]:
                yield linked(held)
                held = []
            held.append((*row, batch.column(5)[at].values.to_numpy(zero_copy_only=False).copy()))
    if held:
        yield linked(held)


def compared(rows: DataFrame, label: str) -> DataFrame:
    tiles = rows.select("block", "tile", "side", "label", "node", "shingles")
    dealt = tiles.repartition("block", "tile").sortWithinPartitions("block", "tile")
    return stage(dealt.mapInArrow(link_tiles, "a long, b long"), label)


def verified(members: DataFrame, part: int | None = None) -> DataFrame:
    """Links (a, b) of ``members`` (node, block, shingles) that connect all pairs of a block with at least ``LEAST``."""
    part = part or PART
    sizes = stage(members.groupBy("block").count(), "blocks")
    small = members.join(sizes.where(F.col("count") <= part), "block", "left_semi")
    whole = small.select("*", F.lit(0).alias("tile"), F.lit(-1).alias("side"), F.col("node").alias("label"))
    found = compared(whole, "links")
    large = sizes.where(F.col("count") > part)
    if large.isEmpty():
        return found
    # Every node with the pivots of its block, in shares of about ``part`` nodes.
    shares = F.ceil(F.col("count") / part).cast("int").alias("shares")
    many = stage(members.join(large.select("block", "count", shares), "block"), "many")
    drawn = F.slice(F.array_sort(F.collect_list(F.xxhash64("node"))), 1, PIVOTS)
    few = many.where(F.pmod(F.xxhash64("node", F.lit("pivot")), F.col("count")) < 4 * PIVOTS)
    pivots = few.groupBy("block").agg(drawn.alias("drawn")).select("block", F.explode("drawn").alias("drawn"))
    chosen = many.join(pivots, (many["block"] == pivots["block"]) & (F.xxhash64(many["node"]) == pivots["drawn"]), "left_semi")
    own = F.pmod(F.xxhash64("node"), F.col("shares")).cast("int")
    spread = chosen.withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).withColumn("side", F.lit(0))
    rest = many.withColumn("tile", own).withColumn("side", F.lit(1))
    first = compared(spread.unionByName(rest).withColumn("label", F.col("node")), "pivot_links")
    # What the pivots linked needs no comparing among itself; all else is compared, each two parts in one tile.
    labels = components(first)
    labelled = many.join(labels, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")
    main = labelled.groupBy("block", "label").count().groupBy("block").agg(F.max_by("label", F.struct("count", "label")).alias("main"))
    kinds = stage(labelled.join(main, "block").withColumn("open", F.col("label") != F.col("main")), "kinds")
    counts = kinds.groupBy("block").agg(F.count_if("open").alias("n_open"), F.count_if(~F.col("open")).alias("n_main"))
    n_open, n_main = (F.ceil(F.col(c) / part).cast("int") for c in ("n_open", "n_main"))
    counts = counts.where("n_open > 0").select("block", n_open.alias("p"), n_main.alias("q"))
    own = F.when(F.col("open"), F.pmod(F.xxhash64("node"), F.col("p"))).otherwise(F.col("p") + F.pmod(F.xxhash64("node"), F.col("q")))
    parts = kinds.join(counts, "block").withColumn("own", own.cast("int"))
    mates = F.when(F.col("open"), F.sequence(F.lit(0), F.col("p") + F.col("q") - 1)).otherwise(F.sequence(F.lit(0), F.col("p") - 1))
    met = parts.withColumn("other", F.explode(mates))
    tile = F.least("own", "other") * (F.col("p") + F.col("q")) + F.greatest("own", "other")
    side = F.when(F.col("own") == F.col("other"), -1).otherwise(F.col("own"))
    return found.union(first).union(compared(met.withColumn("tile", tile).withColumn("side", side), "tile_links"))


def node_links(docs: DataFrame, text_col: str, rows: DataFrame) -> DataFrame:
    """Links (a, b) that connect the nodes of similar texts. ``rows`` holds (copy, node, keys) of all texts."""
    nodes = rows.groupBy("node").agg(F.min("copy").alias("copy"), F.first("keys").alias("keys"))
    lists = stage(nodes.select("node", "copy", F.explode("keys").alias("key")), "lists")
    low = lists.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
    near = lists.join(low.select("key", "low"), "key").where("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b"))
    blocks = components(near)
    heads = blocks.select("component").distinct().select(F.col("component").alias("node"), F.col("component").alias("block"))
    blocks = stage(blocks.select("node", F.col("component").alias("block")).union(heads), "blocks")
    members = stage(lists.select("node", "copy").distinct().join(blocks, "node"), "members")
    texts = docs.select(F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("copy"), F.col(text_col).alias("text"))
    found = texts.join(members, "copy").groupBy("node", "block").agg(F.first("text").alias("text"))
    return verified(stage(found.select("node", "block", shingle_sets(F.col("text")).alias("shingles")), "sets"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", groups: DataFrame | None = None) -> DataFrame:
    """One row of each group of near copies: the one with the smallest id.

    Texts are grouped over chains of similar pairs. Null and empty texts are alike. Rows that share an id count as
    linked, and the one with the least digest stays. Rows without an id are linked by their texts; of a group without any id, one stays.
    ``groups`` (id, group), as another operator found them, are links as well: chains run over both kinds.
    """
    text_batches(docs.sparkSession)
    copy = F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("copy")
    whole = F.xxhash64(*docs.columns).alias("whole")
    read = docs.select(F.col(id_col).alias("id"), copy, whole, sketch(F.col(text_col)).alias("s"))
    rows = stage(read.select("id", "copy", "whole", "s.node", "s.keys"), "sketches")
    ids = rows.where("id is not null").groupBy("id").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
    same = rows.join(ids, "id").select(F.col("node").alias("a"), F.col("low").alias("b"))
    found = node_links(docs, text_col, rows).union(same)
    if groups is not None:
        grouped = rows.join(groups.where("id is not null").distinct(), "id").select("group", "node").distinct()
        heads = grouped.groupBy("group").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
        found = found.union(grouped.join(heads, "group").select(F.col("node").alias("a"), F.col("low").alias("b")))
    groups = components(found)
    named = rows.select("id", "copy", "whole", "node").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    first = F.struct(F.col("id").isNull(), "id", "whole")
    best = named.groupBy("component").agg(F.min(first).alias("first"), F.min("copy").alias("copy"))
    best = stage(best.select("first.id", "first.whole", "copy"), "kept")
    # Rows that share an id are in one component, so of several rows the one with the least digest stays.
    kept = docs.select(nested(docs), F.col(id_col).alias("id"), whole, copy)
    with_id = kept.join(best.where("id is not null").select("id", "whole"), ["id", "whole"], "left_semi").dropDuplicates(["id", "whole"])
    without = kept.where("id is null").join(best.where("id is null").select("copy"), "copy", "left_semi").dropDuplicates(["copy"])
    return unnested(with_id.select("row").unionByName(without.select("row")), docs.columns)
