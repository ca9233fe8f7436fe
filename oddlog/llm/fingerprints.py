"""Homomorphic document fingerprints: sums of wide vectors hashed from paragraphs, modulo a power of two.

A text is the multiset of its paragraphs; here a paragraph ends after a line break or after a full stop, question or
exclamation mark with the white space behind it. Each paragraph is hashed to ``LANES`` signed 16-bit numbers. The
fingerprint is their sum in every lane, modulo 2**32. Sums do not depend on order, equal multisets have equal sums, and
a paragraph is inserted or deleted by adding or subtracting its vector (``combined``, ``without``).

Lanes are centred, so sums of different paragraphs are nearly at right angles, and the cosine of two fingerprints
estimates which part of the paragraphs two texts share. Everything is a DataFrame expression.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import stage

HASHES = 16  # of 64 bits, four lanes each
LANES = 4 * HASHES
MODULUS = 1 << 32
BREAK = r"(?<=[.!?]\s)|(?<=\n)"
NEIGHBOURS = 1000  # rows that are put in order together


def lanes(piece: Column) -> Column:
    """The vector of one paragraph: 16-bit parts of independent 64-bit hashes, centred around zero."""
    hashes = F.array(*(F.xxhash64(F.lit(i), piece) for i in range(HASHES)))
    parts = F.transform(hashes, lambda h: F.array(*(F.shiftright(F.shiftleft(h, 48 - 16 * i), 48) for i in range(4))))
    return F.flatten(parts)


def wrapped(value: Column) -> Column:
    """The representative of ``value`` modulo 2**32 that lies around zero."""
    return F.pmod(value + F.lit(MODULUS // 2), F.lit(MODULUS)) - F.lit(MODULUS // 2)


def combined(left: Column, right: Column) -> Column:
    """The vector of both multisets together: the insertion of ``right`` into ``left``."""
    return F.zip_with(left, right, lambda a, b: wrapped(a + b))


def without(left: Column, right: Column) -> Column:
    """The vector of ``left`` after the deletion of ``right``."""
    return F.zip_with(left, right, lambda a, b: wrapped(a - b))


def paragraphs(text: Column) -> Column:
    """The paragraphs of a text with all their characters; none for an empty or null text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BREAK), lambda p: p != "")


def vector(text: Column) -> Column:
    """The fingerprint of a text as an array of long."""
    none = F.array_repeat(F.lit(0).cast("long"), LANES)
    total = F.aggregate(paragraphs(text), none, lambda total, p: F.zip_with(total, lanes(p), lambda a, b: a + b))
    return F.transform(total, wrapped)


def shown(vec: Column) -> Column:
    """A vector as text: eight hex digits a lane, the lane modulo 2**32."""
    return F.array_join(F.transform(vec, lambda v: F.lower(F.lpad(F.hex(F.pmod(v, F.lit(MODULUS))), 8, "0"))), "")


def dot(left: Column, right: Column) -> Column:
    products = F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def likeness(left: Column, right: Column) -> Column:
    """Cosine of two fingerprints, from 0 to 1; equal ones give 1, an empty text is like nothing but an empty text."""
    size = F.sqrt(dot(left, left)) * F.sqrt(dot(right, right))
    cosine = F.least(F.lit(1.0), F.greatest(F.lit(0.0), dot(left, right) / size))
    return F.when(left == right, 1.0).when(size == 0, 0.0).otherwise(cosine)


def in_order(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with ``place``: groups of about ``NEIGHBOURS`` rows whose numbers ascend with doc_id.

    Ids that are spread evenly give the number by division. Otherwise rows are counted off along a range sort of the ids
    alone. Null ids come first.
    """
    ids = docs.select("doc_id")
    low, high, n, rows = ids.agg(F.min("doc_id"), F.max("doc_id"), F.count("doc_id"), F.count("*")).first()
    if n and n == rows:
        width = max(1, (high - low + 1) * NEIGHBOURS // n)
        if low > -(1 << 62) and high < 1 << 62:  # differences stay within a long
            place = F.expr(f"(doc_id - ({low}L)) div {width}L")
            fullest = ids.groupBy(place.alias("place")).count().agg(F.max("count")).first()[0]
            if fullest <= 4 * NEIGHBOURS:
                return docs.withColumn("place", place)
    once = ids.groupBy("doc_id").agg(F.count("*").alias("copies")).orderBy(F.asc_nulls_first("doc_id"))
    once = stage(once.withColumn("at", F.monotonically_increasing_id()), "order")
    part = F.shiftright("at", 33)
    sizes = once.groupBy(part.alias("part")).agg(F.sum("copies").alias("size"))  # one row per part of the sort
    starts = sizes.select("part", F.sum("size").over(Window.orderBy("part")).alias("end"), "size")
    within = Window.partitionBy("part").orderBy("at")
    counted = once.withColumn("part", part).withColumn("so_far", F.sum("copies").over(within))
    numbered = counted.join(F.broadcast(starts), "part").select(
        F.col("doc_id").alias("known"),
        F.expr(f"(end - size + so_far - 1) div {NEIGHBOURS}").alias("place"),
    )
    return docs.join(numbered, F.col("doc_id").eqNullSafe(F.col("known"))).drop("known")


def edit(text: Column, follower: Column) -> Column:
    """``text`` with its last quarter of code points replaced by as many, or all, of ``follower``'s first ones."""
    n = F.char_length(text)
    quarter = F.floor(n / 4).cast("int")
    return F.concat(F.left(text, n - quarter), F.substr(follower, F.lit(1), quarter))


def compared(rows: DataFrame, *keep: str) -> DataFrame:
    """Digest, vector and likenesses of the edited text; ``rows`` have text, vec, next_text and next_vec."""
    edited = rows.withColumn("edited", edit(F.col("text"), F.col("next_text")))
    edited = edited.withColumn("edited_vec", vector(F.col("edited")))
    return edited.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        "vec",
        "edited_vec",
        likeness(F.col("vec"), F.col("edited_vec")).alias("near_edited"),
        likeness(F.col("vec"), F.col("next_vec")).alias("near_next"),
        *keep,
    )


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row compared with its edited text and with the next row by id; the last row's next is the first.

    Rows that share an id are ordered by text, null ids come first, null texts are empty, a single row follows itself.
    Texts are shuffled once, into groups of neighbours. The first and last row of each group are kept aside, and the
    groups are then treated as the rows were, a thousand at a time, until one group is left.
    """
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = in_order(read).withColumn("vec", vector(F.col("text")))
    order = Window.partitionBy("place").orderBy(F.asc_nulls_first("doc_id"), "text")
    led = rows.select(
        "*",
        F.lead("text").over(order).alias("next_text"),
        F.lead("vec").over(order).alias("next_vec"),
        F.row_number().over(order).alias("at"),
    )
    led = led.withColumns({"is_first": F.col("at") == 1, "is_last": F.col("next_text").isNull()})
    edge = F.when(F.col("is_first") | F.col("is_last"), F.struct("doc_id", "text", "vec"))
    done = stage(compared(led.withColumn("edge", edge), "place", "is_first", "is_last", "edge"), "neighbours")
    result = done.where("not is_last").drop("place", "is_first", "is_last", "edge")
    groups = done.where("is_first or is_last").groupBy("place").agg(
        F.max(F.when(F.col("is_first"), F.col("edge"))).alias("first"),
        F.max(F.when(F.col("is_last"), F.col("edge"))).alias("last"),
    )
    highest = groups.agg(F.max("place")).first()[0]
    while highest is not None:
        groups = stage(groups, "edges")
        over = F.expr("place div 1000")
        within = Window.partitionBy("over").orderBy("place")
        groups = groups.withColumn("over", over).withColumn("follower", F.lead("first").over(within))
        if not highest:  # one group is left: its last row is followed by the first of all
            groups = groups.withColumn("follower", F.col("first"))
        found = groups.where("follower is not null")
        pairs = found.select(
            "last.*", F.col("follower.text").alias("next_text"), F.col("follower.vec").alias("next_vec")
        )
        result = result.unionByName(compared(pairs))
        if not highest:
            break
        groups = groups.groupBy(F.col("over").alias("place")).agg(
            F.min_by("first", groups["place"]).alias("first"), F.max_by("last", groups["place"]).alias("last")
        )
        highest //= 1000
    return result
