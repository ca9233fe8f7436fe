"""Isolation forest: sampling in one scan, trees grown in parallel, scoring without a shuffle.

Liu, Ting, Zhou: "Isolation Forest", ICDM 2008. 100 trees on at most 256 rows each, drawn without replacement.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.names import c
from ..functions.scoring import average_path
from ..session import BROADCAST_ROWS, join_side
from .quantiles import exact_quantiles

TREES, MAX_SAMPLES, CONTAMINATION, SEED = 100, 256, 0.1, 42  # fixed values
FOREST_SCHEMA = "log_type string, tree int, node int, feature int, threshold double, path_length double, node_rows int"
FOREST_COLUMNS = ["log_type", "tree", "node", "feature", "threshold", "path_length", "node_rows"]
NOT_FINITE = "values that are no finite numbers"
DIGITS = 13  # hex digits of a digest that make a random number; a double holds them exactly


def sample_size(rows: int) -> int:
    return min(MAX_SAMPLES, rows)


def draw_plan(rows: dict[str, int], trees: int = TREES) -> list[tuple[str, float, int, int]]:
    """(log type, p, trees per draw, draws).

    A row enters a tree with probability p, sized so that falling short of the sample is a 6-sigma event. One uniform
    number decides membership in several trees at once, each owning an interval of length p; a table too small for
    all trees to fit takes more draws. On a large table that is a single hash per row.
    """
    plan = []
    for log_type, n in rows.items():
        psi = sample_size(n)
        p = min(1.0, (psi + 8 * math.sqrt(psi)) / n)
        per_draw = min(trees, max(1, int(1 / p)))
        plan.append((log_type, p, per_draw, math.ceil(trees / per_draw)))
    return plan


def uniform(text: Column) -> Column:
    """A number in [0, 1) from the MD5 digest of ``text``, the same in any engine."""
    digits = F.substring(F.md5(text.cast("binary")), 1, DIGITS)
    return F.conv(digits, 16, 10).cast("double") / float(16**DIGITS)


def key_text(row_key: list[str]) -> Column:
    """The columns that identify a row as one text; nulls are empty."""
    return F.concat_ws("|", *[F.coalesce(c(k).cast("string"), F.lit("")) for k in row_key])


def draw_samples(
    df: DataFrame, rows: dict[str, int], row_key: list[str] | None, trees: int = TREES, seed: int = SEED
) -> DataFrame:
    """Rows of ``df`` (with ``log_type``) repeated once per tree they were drawn for, with ``_tree``.

    With ``row_key`` (columns that identify a row) the draw depends on content only. Without it the draw uses a seeded
    generator per partition, which is unaffected by copies of a row but follows the file layout. The window keeps at
    most 256 rows per tree; that limit is applied before the shuffle as well.
    """
    plan = draw_plan(rows, trees)
    spark = df.sparkSession
    draws = spark.createDataFrame(plan, "log_type string, _draw_p double, _draw_trees int, _draw_count int")
    key = key_text(row_key) if row_key else F.rand(seed).cast("string")
    few = F.broadcast(draws) if len(plan) <= BROADCAST_ROWS else draws
    keyed = df.withColumn("_draw_key", key).join(few, "log_type")

    def draw(r: Column) -> Column:
        u = uniform(F.concat_ws(":", F.col("_draw_key"), r.cast("string"), F.lit(str(seed))))
        place = F.floor(u / F.col("_draw_p")).cast("int")
        tree = r * F.col("_draw_trees") + place
        inside = (place < F.col("_draw_trees")) & (tree < trees)
        return F.when(inside, F.struct(tree.alias("tree"), u.alias("u")))

    if all(step[3] == 1 for step in plan):
        hits = keyed.withColumn("_draw", draw(F.lit(0))).where("_draw IS NOT NULL")
    else:
        every = F.transform(F.sequence(F.lit(0), F.col("_draw_count") - 1), draw)
        hits = keyed.withColumn("_draw", F.explode(F.array_compact(every)))
    order = Window.partitionBy("log_type", "_tree").orderBy("_draw.u", "_draw_key")
    return (
        hits.withColumn("_tree", F.col("_draw.tree"))
        .withColumn("_draw_place", F.row_number().over(order))
        .where(F.col("_draw_place") <= MAX_SAMPLES)
        .drop("_draw_key", "_draw_p", "_draw_trees", "_draw_count", "_draw", "_draw_place")
    )


def grow(log_type: str, tree: int, x: np.ndarray, seed: int = SEED) -> pd.DataFrame:
    """One isolation tree over the sample ``x`` as heap-numbered nodes (root 1, children 2i and 2i + 1).

    Random numbers are digests of (seed, log type, tree, node), and a split depends on the set of rows only, so neither
    row order nor partitioning matters, and SQL can grow the same tree. Values that are no finite numbers are an error.
    """
    if not np.isfinite(x).all():
        raise ValueError(NOT_FINITE)
    limit = math.ceil(math.log2(max(len(x), 2)))
    nodes, pending = [], [(1, 0, x)]
    while pending:
        node, depth, part = pending.pop()
        low, high = part.min(axis=0), part.max(axis=0)
        open_features = np.flatnonzero(low < high)
        if depth == limit or len(part) == 1 or not len(open_features):
            nodes.append((log_type, tree, node, None, None, depth + average_path(len(part)), len(part)))
            continue
        digest = hashlib.md5(f"{seed}:{log_type}:{tree}:{node}".encode()).hexdigest()
        choice, cut = (int(digest[i : i + DIGITS], 16) / 16**DIGITS for i in (0, DIGITS))
        feature = int(open_features[int(choice * len(open_features))])
        threshold = float(low[feature] + cut * (high[feature] - low[feature]))
        if threshold >= high[feature]:  # rounded up: nothing would go right
            threshold = float(low[feature])
        goes_left = part[:, feature] <= threshold
        nodes.append((log_type, tree, node, feature, threshold, None, len(part)))
        pending.append((2 * node, depth + 1, part[goes_left]))
        pending.append((2 * node + 1, depth + 1, part[~goes_left]))
    out = pd.DataFrame(nodes, columns=FOREST_COLUMNS)
    return out.astype({"feature": "Int32"})


def fit_forest(samples: DataFrame, features: list[str], seed: int = SEED) -> DataFrame:
    """Grow every tree from its drawn rows; groups hold at most 256 rows.

    A tree that cannot be grown is one row with the reason in ``error``, and stops no other.
    """

    def grow_group(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        try:
            return grow(key[0], int(key[1]), pdf[features].to_numpy(dtype=float), seed).assign(error=None)
        except Exception as problem:  # noqa: BLE001 - reported per log type
            failed = pd.DataFrame([{"log_type": key[0], "tree": int(key[1]), "error": str(problem) or type(problem).__name__}])
            return failed.reindex(columns=[*FOREST_COLUMNS, "error"])

    return samples.select("log_type", F.col("_tree").alias("tree"), *features).groupBy("log_type", "tree").applyInPandas(
        grow_group, f"{FOREST_SCHEMA}, error string"
    )


def pack(forest: pd.DataFrame, width: int) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """Per log type: split features, thresholds and path lengths as [tree, node] arrays of full depth.

    A leaf above the last level sends every row left, so all walks take the same number of steps. A split on a feature
    that the ``width`` columns of the matrix do not hold is an error, as the forest belongs to another selection.
    """
    splits = forest["threshold"].notna()
    outside = forest[splits & ~forest["feature"].between(0, width - 1)]
    if len(outside):
        first = outside.iloc[0]
        raise ValueError(f"forest of {first['log_type']} splits on feature {first['feature']}, the matrix has {width}")
    packed = {}
    for log_type, rows in forest.groupby("log_type"):
        depth = int(rows["node"].max()).bit_length() - 1
        trees = {t: i for i, t in enumerate(sorted(rows["tree"].unique()))}
        feature = np.zeros((len(trees), 2**depth), dtype=np.intp)
        threshold = np.full((len(trees), 2**depth), np.inf)
        length = np.zeros((len(trees), 2 ** (depth + 1)))
        index = rows["tree"].map(trees).to_numpy()
        node = rows["node"].to_numpy()
        split = rows["threshold"].notna().to_numpy()
        feature[index[split], node[split]] = rows["feature"].to_numpy()[split].astype(np.intp)
        threshold[index[split], node[split]] = rows["threshold"].to_numpy()[split]
        for t, n, path in zip(index[~split], node[~split], rows["path_length"].to_numpy()[~split]):
            length[t, int(n) << (depth + 1 - int(n).bit_length())] = path
        packed[log_type] = (feature, threshold, length, depth)
    return packed


def mean_path(packed: tuple[np.ndarray, np.ndarray, np.ndarray, int], x: np.ndarray) -> np.ndarray:
    """Mean path length of every row of ``x`` (columns are features) over all trees."""
    feature, threshold, length, depth = packed
    flat, rows = np.ascontiguousarray(x.T).ravel(), np.arange(len(x))
    total = np.zeros(len(x))
    for f, t, l in zip(feature * len(x), threshold, length):
        node = np.ones(len(x), dtype=np.intp)
        for _ in range(depth):
            node = 2 * node + (flat[f[node] + rows] > t[node])
        total += l[node]
    return total / len(feature)


def share_forest(forest: DataFrame, width: int) -> Broadcast:
    """A forest packed and sent to the executors once: at most 100 trees x 511 nodes per log type.

    Its size is checked by the caller (:data:`oddlog.operators.detect.FOREST_ROWS`).
    """
    return forest.sparkSession.sparkContext.broadcast(pack(forest.toPandas(), width))


def path_lengths(packed: Broadcast, features: list[str], log_type: str = "log_type") -> Column:
    """Column expression with the mean path length of each row in its log type's shared forest."""
    if not features:
        return F.lit(None).cast("double")

    @F.pandas_udf("double")
    def walk(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for kinds, *columns in batches:
            x = np.column_stack([col.to_numpy(dtype=float) for col in columns])
            out = np.full(len(kinds), np.nan)
            for kind, places in kinds.groupby(kinds).indices.items():
                if kind in packed.value:
                    out[places] = mean_path(packed.value[kind], x[places])
            yield pd.Series(out)

    return F.nanvl(walk(c(log_type), *[c(f) for f in features]), F.lit(None))


def anomaly_score(path: Column, normal_path: Column) -> Column:
    """score_samples: -2^(-path / c(psi)); lower is more unusual."""
    return -F.pow(F.lit(2.0), -path / normal_path)


def score_offsets(scores: DataFrame, contamination: float = CONTAMINATION) -> DataFrame:
    """(log_type, offset): exact contamination quantile of the training scores."""
    return exact_quantiles(scores, ["log_type"], {"offset": contamination}, "score")


def anomaly_rates(scores: DataFrame, offsets: DataFrame) -> DataFrame:
    """(log_type, anomaly_rate): share of training rows whose decision value is below zero."""
    decided = scores.join(join_side(offsets, "offsets"), "log_type")
    return decided.groupBy("log_type").agg(
        F.avg(F.when(F.col("score") - F.col("offset") < 0, 1.0).otherwise(0.0)).alias("anomaly_rate")
    )
