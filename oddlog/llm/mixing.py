"""Mixing sources to target weights by iterative proportional fitting.

Token weights of the cells (source x language x topic) are scaled in turn so that each dimension meets its target
shares, for ``sweeps`` rounds. A cell's factor is its fitted weight over its tokens, about 1 on average. A document is
then drawn with probability min(1, rate * factor), by a hash of its id, so the same documents are drawn every time. Where
that is capped at 1, the column ``weight`` says how often a document should be seen for the marginals to hold. Without a
rate the weights are raked within what each cell has (``rake_within``): no probability is above 1, all weights are 1, and
the drawn rows alone meet the marginals but for ``SLACK``, which a few rare values may lack.

A target is either a dictionary of shares (what is not listed shares the rest in proportion to its tokens) or a number:
the exponent to which the present shares are raised (1 keeps them, 0 makes all values equal).

Only cells are raked, never documents: tokens are summed per cell before the shuffle, so hot sources cost nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import nested, stage, unnested

SWEEPS = 10
BOUNDED_SWEEPS = 20  # where no cell may be asked for more than it has
AT_ONCE = 2  # sweeps planned as one job; each sweep sorts the cells once a dimension
RATES = [i / 50 for i in range(1, 51)]  # at which goals are tried to be met within what there is
SLACK = 0.025  # of the tokens, which may miss their goals in each dimension
RATE = 0.5
TARGETS: dict[str, float | dict[str, float]] = {"source": 0.5, "lang": 0.5, "topic": 0.7}
FEW = 100_000  # cells up to which they are kept in one task and broadcast
FEW_BYTES = 16 << 20
NONE = "none"
WORD = r"[^ \t\n\r]+"

# What marks a text's topic, in this order.
TOPICS = {
    "legal": r"[Ll]icen[cs]e|[Cc]opyright|rights reserved",
    "contact": r"@[a-z0-9.]+\.|\+1 \(",
    "table": r" \| ",
    "symbols": r"%%%|###|\$\$\$|!! ",
}


def tokens(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def topic(text: Column) -> Column:
    """The first topic of ``TOPICS`` whose pattern a text holds, otherwise prose."""
    filled = F.coalesce(text, F.lit(""))
    tests = [(F.lit(name), F.regexp_like(filled, F.lit(pattern))) for name, pattern in TOPICS.items()]
    first = F.when(tests[0][1], tests[0][0])
    return reduce(lambda found, test: found.when(test[1], test[0]), tests[1:], first).otherwise("prose")


def with_sums(cells: DataFrame, by: str | None, few: bool, **sums: Column) -> DataFrame:
    """``cells`` with sums over the cells that share the value ``by``, or over all. Few cells are summed where they are."""
    if few:
        whole = Window.partitionBy(by) if by else Window.partitionBy()
        return cells.withColumns({name: F.sum(what).over(whole) for name, what in sums.items()})
    summed = cells.groupBy(*([by] if by else [])).agg(*(F.sum(what).alias(name) for name, what in sums.items()))
    return cells.join(summed, by) if by else cells.crossJoin(F.broadcast(summed))  # one row


def with_goals(cells: DataFrame, targets: dict[str, float | dict[str, float]], few: bool) -> DataFrame:
    """``cells`` with ``goal_`` columns: the tokens that the cell's value of each dimension should have in all."""
    for dim, wanted in targets.items():
        cells = with_sums(cells, dim, few, mine=F.col("tokens"))
        if isinstance(wanted, dict):
            listed = F.create_map(*(F.lit(x) for pair in wanted.items() for x in pair))[F.col(dim)]
            rest = max(0.0, 1.0 - sum(wanted.values()))
            part = F.when(listed.isNull(), F.col("tokens"))
            share = F.coalesce(listed, F.try_divide(F.lit(rest) * F.col("mine"), "parts"), F.lit(0.0))
        else:
            # Summed over cells, tokens * mine ** (wanted - 1) is mine ** wanted summed over values.
            part = F.when(F.col("tokens") > 0, F.col("tokens") * F.pow("mine", F.lit(wanted - 1.0)))
            share = F.pow("mine", F.lit(float(wanted))) / F.col("parts")
        cells = with_sums(cells, None, few, total=F.col("tokens"), parts=part)
        cells = cells.withColumns({f"goal_{dim}": F.col("total") * share, f"has_{dim}": F.col("mine")})
        cells = cells.drop("mine", "total", "parts")
    return cells


def swept(fitted: DataFrame, targets, sweeps: int, few: bool, step) -> DataFrame:
    """``fitted`` after ``step(rows, dim)`` for every dimension, ``sweeps`` times. Lineage is cut after ``AT_ONCE`` sweeps."""
    for sweep in range(sweeps):
        if sweep % AT_ONCE == 0:
            fitted = stage(fitted, "raked")
            fitted = fitted.coalesce(1) if few else fitted
        for dim in targets:
            fitted = step(fitted, dim)
    return fitted


def rake(
    cells: DataFrame, targets: dict[str, float | dict[str, float]], sweeps: int = SWEEPS, few: bool = False
) -> DataFrame:
    """``cells`` (one column per dimension, tokens double) with ``factor``; cells without tokens have factor 1.

    ``few`` cells are kept in one task, which spares all shuffles.
    """

    def step(fitted: DataFrame, dim: str) -> DataFrame:
        summed = with_sums(fitted, dim, few, now=F.col("fitted"))
        scale = F.coalesce(F.try_divide(f"goal_{dim}", "now"), F.lit(0.0))
        return summed.withColumn("fitted", F.col("fitted") * scale).drop("now")

    fitted = with_goals(cells.coalesce(1) if few else cells, targets, few).withColumn("fitted", F.col("tokens"))
    fitted = swept(fitted, targets, sweeps, few, step)
    factor = F.coalesce(F.try_divide("fitted", "tokens"), F.lit(1.0))
    return fitted.select(*targets, "tokens", factor.alias("factor"))


def short(goals: DataFrame, dim: str) -> dict[float, float]:
    """Per rate, the part of the goals of ``dim`` that its values have no tokens for."""
    values = goals.groupBy(dim).agg(F.max(f"goal_{dim}").alias("goal"), F.max(f"has_{dim}").alias("has"))
    missed = [F.sum(F.greatest(F.lit(0.0), F.col("goal") - F.col("has") / r)).alias(str(r)) for r in RATES]
    row = values.agg(F.sum("goal").alias("all"), *missed).first()
    return {r: (row[str(r)] or 0.0) / (row["all"] or 1.0) for r in RATES}


def rake_within(
    cells: DataFrame,
    targets: dict[str, float | dict[str, float]],
    slack: float = SLACK,
    sweeps: int = BOUNDED_SWEEPS,
    few: bool = False,
) -> DataFrame:
    """``cells`` with ``factor``, which is never above 1: no cell is asked for more tokens than it has.

    All goals are multiplied by one rate, the largest of ``RATES`` at which the values of each dimension that have less
    than their goals miss at most ``slack`` of all tokens together. Such values are kept whole, all others meet their
    goals. In a sweep, a value below its goal gains in those cells that are not yet whole; a value above it loses in all
    its cells.
    """
    fitted = stage(with_goals(cells.coalesce(1) if few else cells, targets, few), "goals")
    missed = [short(fitted, dim) for dim in targets]
    rate = max((r for r in RATES if all(part[r] <= slack for part in missed)), default=RATES[0])

    def step(fitted: DataFrame, dim: str) -> DataFrame:
        whole = F.when(F.col("fitted") >= F.col("tokens"), F.col("fitted")).otherwise(0.0)
        summed = with_sums(fitted, dim, few, now=F.col("fitted"), full=whole)
        goal = F.col(f"goal_{dim}") * rate
        more = F.coalesce(F.try_divide(goal - F.col("full"), F.col("now") - F.col("full")), F.lit(1.0))
        grown = F.least(F.col("tokens"), F.col("fitted") * F.when(F.col("fitted") >= F.col("tokens"), 1.0).otherwise(more))
        cut = F.col("fitted") * F.coalesce(F.try_divide(goal, "now"), F.lit(0.0))
        return summed.withColumn("fitted", F.when(F.col("now") > goal, cut).otherwise(grown)).drop("now", "full")

    fitted = swept(fitted.withColumn("fitted", F.col("tokens") * rate), targets, sweeps, few, step)
    factor = F.coalesce(F.try_divide("fitted", "tokens"), F.lit(1.0))
    return fitted.select(*targets, "tokens", factor.alias("factor"))


def draw(key: Column) -> Column:
    """A number from 0 to 1 that depends on the key only."""
    digest = F.md5(F.concat(F.coalesce(key, F.lit("")), F.lit(":mix")).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def mix(
    docs: DataFrame,
    targets: dict[str, float | dict[str, float]] = TARGETS,
    rate: float | None = RATE,
    sweeps: int = SWEEPS,
    id_col: str = "doc_id",
    text_col: str = "text",
    token_col: str | None = None,
) -> DataFrame:
    """The drawn rows of ``docs`` with ``topic``, ``tokens``, ``probability`` and ``weight`` in a struct ``mixing``,
    which replaces a column of that name.

    Dimensions are columns of ``docs``, or the ``topic`` of the text where there is no such column. Null values of a
    dimension are the value ``none``. Null and empty texts have no tokens and are drawn with their cell. Rows with equal
    ids are drawn together, rows without an id are drawn by their text. An empty table stays empty.
    """
    own = [d for d in targets if d not in docs.columns and d != "topic"]
    if own:
        raise ValueError(f"no such columns: {own}")
    dims = {
        d: F.coalesce(F.col(d).cast("string"), F.lit(NONE)) if d in docs.columns else topic(F.col(text_col)) for d in targets
    }
    weight = F.col(token_col).cast("long") if token_col else tokens(F.col(text_col))
    amount = F.coalesce(weight, F.lit(0)).cast("double").alias("tokens")
    described = F.struct(*(c.alias(d) for d, c in dims.items()), amount)
    cells = docs.select(described.alias("m")).groupBy(*(F.col(f"m.{d}").alias(d) for d in dims))
    cells = stage(cells.agg(F.sum("m.tokens").alias("tokens")), "cells")
    n, size = cells.agg(F.count("*"), F.sum(sum((F.octet_length(d) for d in dims), F.lit(0)))).first()
    few = n <= FEW and (size or 0) <= FEW_BYTES
    raked = rake_within(cells, targets, few=few) if rate is None else rake(cells, targets, sweeps, few)
    rate = 1.0 if rate is None else rate
    factors = stage(raked, "factors")
    right = factors.select(F.struct(*dims).alias("cell"), "factor")
    key = F.coalesce(F.col(id_col).cast("string"), F.col(text_col)).alias("key")
    marked = docs.select(nested(docs), key, described.alias("mixing"))
    own_cell = F.struct(*(F.col(f"mixing.{d}").alias(d) for d in dims))
    joined = marked.join(F.broadcast(right) if few else right, own_cell == F.col("cell"))
    chance = F.least(F.lit(1.0), F.lit(rate) * F.col("factor"))
    kept = joined.where(draw(F.col("key")) < chance)
    more = F.struct("mixing.*", chance.alias("probability"), (F.lit(rate) * F.col("factor") / chance).alias("weight"))
    return unnested(kept.select("row", more.alias("mixing")), docs.columns, "mixing")


def sql(targets: dict[str, float], rate: float, sweeps: int) -> str:
    """The same as SQL for tempered targets over ``documents``."""
    cases = " ".join(f"WHEN regexp_matches(coalesce(text, ''), '{p}') THEN '{name}'" for name, p in TOPICS.items())
    dims = ", ".join(targets)
    parts = [
        f"""WITH marked AS (SELECT doc_id, coalesce(source, '{NONE}') AS source, coalesce(lang, '{NONE}') AS lang,
        CASE {cases} ELSE 'prose' END AS topic,
        len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::DOUBLE AS tokens,
        ('0x' || substr(md5(coalesce(doc_id::VARCHAR, text, '') || ':mix'), 1, 13))::BIGINT / {float(16**13)} AS draw
        FROM documents),
        cells AS (SELECT {dims}, sum(tokens) AS tokens FROM marked GROUP BY ALL),
        mine AS (SELECT *, {", ".join(f"sum(tokens) OVER (PARTITION BY {d}) AS mine_{d}" for d in targets)} FROM cells),
        s0 AS (SELECT *, tokens AS fitted, {", ".join(
            f"sum(tokens) OVER () * pow(mine_{d}, {a}) / sum(CASE WHEN tokens > 0 THEN tokens * pow(mine_{d}, {a - 1.0}) END) OVER () AS goal_{d}"
            for d, a in targets.items())} FROM mine)"""
    ]
    last = "s0"
    for sweep in range(sweeps):
        for d in targets:
            name = f"s{sweep + 1}_{d}"
            scaled = f"fitted * coalesce(goal_{d} / nullif(sum(fitted) OVER (PARTITION BY {d}), 0), 0)"
            parts.append(f"{name} AS MATERIALIZED (SELECT * REPLACE ({scaled} AS fitted) FROM {last})")
            last = name
    parts.append(f"factors AS (SELECT {dims}, coalesce(fitted / nullif(tokens, 0), 1) AS factor FROM {last})")
    return (
        ",\n".join(parts)
        + f"""
        SELECT doc_id, source, lang, topic, tokens::BIGINT AS n_tokens, round(least(1.0, {rate} * factor), 6) AS probability,
        round({rate} * factor / least(1.0, {rate} * factor), 6) AS weight
        FROM marked JOIN factors USING ({dims}) WHERE draw < least(1.0, {rate} * factor)"""
    )
