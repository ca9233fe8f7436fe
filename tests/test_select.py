import math
import random

import pytest

from oddlog.operators import select

BY = ["log_type"]
SCHEMA = (
    "log_type string, feature string, position int, is_category boolean, type string, rows bigint, unique_count bigint,"
    " total bigint, entropy_bits double"
)


def score_of(row):
    if row["type"] == "numerical":
        cover, card, info = 1.0, min(1000, row["rows"] // 10), 0.7
    else:
        cover, card = row["total"] / row["rows"], row["unique_count"]
        info = row["entropy_bits"] / math.log2(card) if card > 1 else row["entropy_bits"]
    part = card / 100 if card <= 100 else max(0.1, 1 - (card - 100) / 900)
    bonus = 0.2 if row["feature"] in ("hour", "day_of_week") else 0.0
    return cover, card, 0.4 * cover + 0.3 * part + 0.3 * info + bonus


def brute_force(rows, minimum, target):
    """The selection rules applied one after the other to a handful of rows."""
    ordered = sorted(rows, key=lambda r: (not r["is_category"], r["position"]))
    usable = []
    for row in ordered:
        cover, card, score = score_of(row)
        if row["feature"] != "is_business_hours" and cover >= minimum and 2 <= card <= 1000:
            usable.append((row, score))
    names = []
    for row, _ in sorted(usable, key=lambda p: -round(p[1], 12)):
        if len(names) < target and not (row["feature"] == "hour_of_day" and "hour" in names):
            names.append(row["feature"])
    types = {r["feature"]: r["type"] for r in rows}
    if not any(types[n] == "numerical" for n in names):
        spare = [t for t in ("hour", "day_of_week") if t in types and t not in names]
        names = names + spare[: max(1, target - len(names))]
        categories = [n for n in names if types[n] == "categorical"]
        kept = categories[: len(categories) - max(0, len(names) - target)]
        names = [n for n in names if types[n] == "numerical" or n in kept]
    return names


def make(rng, log_type, n):
    rows = []
    pool = ["hour", "day_of_week", "hour_of_day", "is_business_hours"] + [f"f{i}" for i in range(10)]
    for position, name in enumerate(rng.sample(pool, rng.randint(3, 12))):
        numeric = name in ("hour", "day_of_week", "hour_of_day") or rng.random() < 0.15
        unique = rng.choice([2, 5, 40, 300, 900])
        rows.append(
            {
                "log_type": log_type,
                "feature": name,
                "position": position,
                "is_category": not numeric,
                "type": "numerical" if numeric else "categorical",
                "rows": n,
                "unique_count": None if numeric else unique,
                "total": None if numeric else rng.randint(1, n),
                "entropy_bits": None if numeric else rng.random() * math.log2(unique),
            }
        )
    return rows


@pytest.mark.parametrize("target", [2, 4, 10])
def test_selection_matches_brute_force(spark, target):
    rng = random.Random(target)
    groups = {f"t{i}": make(rng, f"t{i}", rng.choice([15, 19, 500])) for i in range(60)}
    df = spark.createDataFrame([tuple(r.values()) for rows in groups.values() for r in rows], SCHEMA)
    got = {}
    for row in select.select_features(df, BY, target).collect():
        got.setdefault(row.log_type, []).append(row)
    for name, rows in groups.items():
        want = next((w for w in (brute_force(rows, c, target) for c in (0.6, 0.5, 0.3, 0.1)) if w), [])
        chosen = sorted(got.get(name, []), key=lambda r: r["rank"])
        assert [r.feature for r in chosen] == want, name
        slots = sorted(chosen, key=lambda r: r.slot)
        assert [r.slot for r in slots] == list(range(len(slots)))
        assert [r.is_category for r in slots] == sorted((r.is_category for r in slots), reverse=True)


def test_detection_marks_only_well_covered_features(spark):
    rows = [
        ("t", "a", 0, True, "categorical", 100, 10, 65, 3.0),
        ("t", "b", 1, True, "categorical", 100, 10, 95, 3.0),
        ("t", "n", 2, False, "numerical", 100, None, None, None),
    ]
    chosen = select.select_features(spark.createDataFrame(rows, SCHEMA), BY)
    marked = {r.feature: r for r in select.mark_optimal(chosen, BY).collect()}
    assert {f: r.is_optimal for f, r in marked.items()} == {"a": False, "b": True, "n": True}
    assert marked["a"].optimal_rank is None and marked["a"]["rank"] is not None
