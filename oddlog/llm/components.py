"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import stage


def stars(links: DataFrame) -> DataFrame:
    """One round: every vertex hands its larger, then its smaller neighbours to the least vertex it sees."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low"))
    large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b")
    down = large.distinct()
    low = down.groupBy("a").agg(F.min("b").alias("low"))
    small = down.join(low, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return small.union(low.select("a", F.col("low").alias("b"))).distinct()


def state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, component): every vertex of ``links`` (a, b) that is not the least of its component, with the least one.

    Alternating large and small stars (Kiveris et al. 2014): the rounds grow with the logarithm of the vertices, a
    vertex's neighbours are only ever reduced to their minimum, and each round is a table in the shared folder. The
    driver sees a count and a checksum per round. Rows with a null end, and links of a vertex to itself, are ignored.
    """
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    links = stage(links, "links")
    before = state(links)
    while before[0]:
        links = stage(stars(links), "stars")
        after = state(links)
        if after == before:
            break
        before = after
    return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
