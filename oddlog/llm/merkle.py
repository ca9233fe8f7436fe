"""A Merkle manifest of a dataset: every row a leaf, runs of eight nodes a parent, one subroot a group, one root in all.

Leaves of a group are numbered in order and cut into aligned blocks of 512. A block keeps each of its levels as one string
of concatenated hex digests: parents are hashes of fixed-width substrings, and what stands before and behind a node in its
run are its siblings. The roots of blocks are the nodes of the next round, so the rounds grow with the logarithm of the
rows to base 512. The subroots of all groups, in the order of their names, are folded in the same way.

Everything is a DataFrame expression. Rows are put in order by digest and key alone, texts are never shuffled, and a block
never holds more than 512 rows, whatever a group's size.

Null fields are ``-``, empty ones ``0:``. Null groups come first and have a subroot of their own, null keys come first in
their group. Rows of equal keys are ordered by their leaf; equal rows stand side by side and differ in their place only.
A table without rows has no manifest rows. Columns that are not named are ignored, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from oddlog.session import join_side

from .common import group_key, stage

ARITY = 8
LEVELS = 3  # levels that a block folds
BLOCK = ARITY**LEVELS
HEX = 64
RUN = ARITY * HEX
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field(value: Column) -> Column:
    """A value as it enters a leaf: ``-`` for null, otherwise its length in bytes, a colon and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``place`` (from 0 in its ``group``, by ``order``) and ``size`` (rows of the group).

    Rows are sorted by range, so a large group is spread over many tasks. What is counted are runs: one row for each task
    of the sort and group in it.
    """
    rows = stage(rows, "unordered")  # else the sort's sample would work all digests out once more
    ordered = rows.repartitionByRange("group", *order).sortWithinPartitions("group", *order)
    ordered = stage(ordered.withColumn("at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("at", 33)
    runs = ordered.groupBy("group", part.alias("part")).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    whole = Window.partitionBy("group")
    before = F.sum("n").over(whole.orderBy("part")) - F.col("n")
    runs = runs.select("group", "part", (before - F.col("first")).alias("shift"), F.sum("n").over(whole).alias("size"))
    placed = ordered.withColumn("part", part).join(join_side(runs, "runs"), ["group", "part"])
    return placed.select(*rows.columns, (F.col("at") + F.col("shift")).alias("place"), "size")


def parents(level: Column) -> Column:
    """The next level of a block: the hashes of its runs."""
    runs = F.sequence(F.lit(0), F.floor((F.length(level) - 1) / RUN).cast("int"))
    return F.array_join(F.transform(runs, lambda j: F.sha2(F.substr(level, j * RUN + 1, F.lit(RUN)), 256)), "")


def blocks(nodes: DataFrame) -> DataFrame:
    """(group, block, size, members, level0 ..., root) of nodes (group, place, size, digest, keep), stored.

    A level is null where the group has too few nodes for it; the last one that is not null is the block's root.
    """
    member = F.struct("place", "digest", "keep")
    together = nodes.groupBy("group", F.expr(f"place div {BLOCK}").alias("block")).agg(
        F.max("size").alias("size"), F.collect_list(member).alias("members")
    )
    in_place = F.array_sort("members", lambda a, b: (a["place"] - b["place"]).cast("int"))
    rows = together.withColumn("members", in_place)
    rows = rows.withColumn("level0", F.array_join(F.transform("members", lambda m: m["digest"]), ""))
    rows = rows.withColumn("members", F.transform("members", lambda m: m["keep"]))
    for k in range(LEVELS):
        rows = rows.withColumn(f"level{k + 1}", F.when(F.col("size") > ARITY**k, parents(F.col(f"level{k}"))))
    root = F.coalesce(*(F.col(f"level{k}") for k in reversed(range(LEVELS + 1))))
    return stage(rows.withColumn("root", root), "blocks")


def segments(at: Column) -> Column:
    """What stands before and behind the node ``at`` (from 0 in its block) in its run, level by level."""
    found = []
    for k in range(LEVELS):
        own = F.shiftright(at, 3 * k)
        inside = F.pmod(own, F.lit(ARITY))
        level = F.col(f"level{k}")
        left = F.substr(level, (own - inside) * HEX + 1, inside * HEX)
        right = F.substr(level, (own + 1) * HEX + 1, (ARITY - 1 - inside) * HEX)
        found.append(F.when(F.col(f"level{k + 1}").isNotNull(), F.struct(left.alias("left"), right.alias("right"))))
    return F.filter(F.array(*found), lambda s: s.isNotNull())


def climbed(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Paths (group, keep, digest, path, root) of all nodes, and (group, root) of all groups."""
    rounds = [blocks(nodes)]
    while not (more := rounds[-1].where(F.col("size") > BLOCK)).isEmpty():
        size = F.ceil(F.col("size") / BLOCK).alias("size")
        rounds.append(blocks(more.select("group", F.col("block").alias("place"), size, F.col("root").alias("digest"), F.lit(0).alias("keep"))))
    tops = rounds[0].where(F.col("size") <= BLOCK).select("group", "root")
    for later in rounds[1:]:
        tops = tops.union(later.where(F.col("size") <= BLOCK).select("group", "root"))
    above = None
    for table in reversed(rounds):
        shared, root = F.expr("array()"), F.col("root")
        if above is not None:
            table = table.join(above, ["group", "block"], "left")
            shared, root = F.coalesce("shared", F.expr("array()")), F.coalesce("above", "root")
        levels = [f"level{k}" for k in range(LEVELS + 1)]
        each = table.select("group", "block", *levels, shared.alias("up"), root.alias("top"), F.posexplode("members").alias("at", "keep"))
        path = F.concat(segments(F.col("at")), F.col("up"))
        digest = F.substr("level0", F.col("at") * HEX + 1, F.lit(HEX))
        paths = each.select("group", (F.col("block") * BLOCK + F.col("at")).alias("place"), "keep", digest.alias("digest"), path.alias("path"), F.col("top").alias("root"))
        above = paths.select("group", F.col("place").alias("block"), F.col("path").alias("shared"), F.col("root").alias("above"))
    return paths.drop("place"), tops


def fold(digest: Column, path: Column) -> Column:
    """The root that follows from a leaf and the siblings on its path."""
    return F.aggregate(path, digest, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


def proof(path: Column) -> Column:
    """One digest of all siblings on a path, from the leaf upwards, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def manifest(rows: DataFrame, digest: Column, group: Column, key: Column, keep: Column) -> DataFrame:
    """(keep, leaf, subroot, root, path) of every row: its leaf ``digest`` in the tree of its ``group``, by ``key``.

    ``path`` are the siblings from the leaf over the subroot up to the root; ``fold(leaf, path)`` is the root. ``keep``
    is carried along unchanged.
    """
    leaves = rows.select(group_key(group).alias("group"), key.alias("key"), digest.alias("digest"), keep.alias("keep"))
    paths, tops = climbed(numbered(leaves, ["key", "digest"]))
    subroots = tops.select(F.lit("").alias("group"), F.col("group").alias("keep"), F.col("root").alias("digest"))
    upper, _ = climbed(numbered(subroots, ["keep"]))
    upper = upper.select(F.col("keep").alias("group"), F.col("digest").alias("subroot"), F.col("path").alias("last"), F.col("root").alias("all"))
    joined = paths.drop("root").join(join_side(upper, "subroots"), "group")
    path = F.concat("path", "last").alias("path")
    return joined.select("keep", F.col("digest").alias("leaf"), "subroot", F.col("all").alias("root"), path)


# The same as SQL over ``documents``, with {crc} for the checksum of a row's id.
SQL = """WITH RECURSIVE fields AS (SELECT doc_id, lang, {crc} % 3 = 0 AS tampered,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
    || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS body,
    coalesce(strlen(text) || ':' || translate(text, '{upper}', '{lower}'), '-') AS other FROM documents),
leaves AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
    row_number() OVER (ORDER BY lang, doc_id, leaf) AS id, count(*) OVER (PARTITION BY lang) AS n FROM (
    SELECT doc_id, lang, sha256(head || body) AS leaf,
    CASE WHEN tampered THEN sha256(head || other) ELSE sha256(head || body) END AS seen FROM fields)),
nodes AS (SELECT lang, 0 AS level, idx, n, leaf AS digest FROM leaves UNION ALL
    SELECT lang, level + 1, idx // 8, (any_value(n) + 7) // 8, sha256(string_agg(digest, '' ORDER BY idx))
    FROM nodes WHERE n > 1 GROUP BY lang, level, idx // 8),
subroots AS (SELECT lang, digest, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS idx, count(*) OVER () AS n
    FROM nodes WHERE n = 1),
tops AS (SELECT 0 AS level, idx, n, digest FROM subroots UNION ALL
    SELECT level + 1, idx // 8, (any_value(n) + 7) // 8, sha256(string_agg(digest, '' ORDER BY idx))
    FROM tops WHERE n > 1 GROUP BY level, idx // 8),
walk AS (SELECT id, lang, 0 AS level, idx, seen AS folded, '' AS proof FROM leaves UNION ALL
    SELECT w.id, w.lang, w.level + 1, w.idx // 8,
    sha256(string_agg(CASE WHEN o.idx = w.idx THEN w.folded ELSE o.digest END, '' ORDER BY o.idx)),
    w.proof || coalesce(string_agg(CASE WHEN o.idx <> w.idx THEN o.digest END, '' ORDER BY o.idx), '')
    FROM walk w JOIN nodes o ON o.lang IS NOT DISTINCT FROM w.lang AND o.level = w.level AND o.idx // 8 = w.idx // 8
    WHERE o.n > 1 GROUP BY w.id, w.lang, w.level, w.idx, w.folded, w.proof),
arrived AS (SELECT id, lang, arg_max(folded, level) AS folded, arg_max(proof, level) AS proof FROM walk GROUP BY id, lang),
rise AS (SELECT a.id, 0 AS level, s.idx, a.folded, a.proof
    FROM arrived a JOIN subroots s ON s.lang IS NOT DISTINCT FROM a.lang UNION ALL
    SELECT w.id, w.level + 1, w.idx // 8,
    sha256(string_agg(CASE WHEN o.idx = w.idx THEN w.folded ELSE o.digest END, '' ORDER BY o.idx)),
    w.proof || coalesce(string_agg(CASE WHEN o.idx <> w.idx THEN o.digest END, '' ORDER BY o.idx), '')
    FROM rise w JOIN tops o ON o.level = w.level AND o.idx // 8 = w.idx // 8
    WHERE o.n > 1 GROUP BY w.id, w.level, w.idx, w.folded, w.proof),
ends AS (SELECT id, arg_max(folded, level) AS folded, arg_max(proof, level) AS proof FROM rise GROUP BY id)
SELECT l.doc_id, l.leaf, s.digest AS subroot, t.digest AS root, sha256(e.proof) AS proof_sha256,
    e.folded AS folded_root, e.folded = t.digest AS verified
FROM leaves l JOIN ends e USING (id) JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.lang
    JOIN tops t ON t.n = 1"""
