import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from oddlog.session import new_path
from oddlog.streaming import ingest
from oddlog.streaming.ingest import first_of_key, ingest_counts, start_ingest
from oddlog.streaming.score import read_events

EVENT = "id string, timestamp timestamp, note struct<n:bigint,tags:array<string>>"
START = datetime(2024, 1, 1)
WINDOW, LATE = 5, 2


def event(key, day, n, hour=1):
    return (key, None if day is None else START + timedelta(days=day, hours=hour), (n, ["x", None]))


def put(spark, path, *batches):
    for rows in batches:
        spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(path)


def run(spark, path, out, checkpoint):
    events = read_events(spark, path, spark.createDataFrame([], EVENT).schema, "parquet", maxFilesPerTrigger=1)
    query = start_ingest(events, out, checkpoint, WINDOW, LATE)
    query.awaitTermination()
    return query


def plain(batches):
    """The same by a loop: late by the watermark of the batch before the last, then the first of each key."""
    last, kept, counts, marks = {}, [], [], [-10**6, -10**6]
    for rows in batches:
        late = [r for r in rows if (r[1] - START).days <= marks[-2]]
        rest = sorted((r for r in rows if r not in late), key=lambda r: r[1])
        passed = []
        for r in rest:
            day = (r[1] - START).days
            if r[0] not in last or abs(day - last[r[0]]) >= WINDOW:
                last[r[0]] = day
                passed.append(r)
        kept += passed
        counts.append((len(rows), len(late), len(rest) - len(passed), len(passed)))
        marks.append(max([marks[-1], *((r[1] - START).days - LATE for r in rows)]))
    return sorted(r[2][0] for r in kept), counts


def test_batches_and_a_restart_equal_the_plain_loop(spark):
    path, out, checkpoint = (new_path(spark, f"t-ingest-{n}") for n in ("in", "out", "check"))
    batches = [
        [event("a", 0, 1), event("a", 0, 2, 3), event("b", 1, 3), event("hot", 1, 4, 2)] + [event("hot", 1, 100 + i, 5) for i in range(500)],
        [event("a", 4, 5), event("b", 6, 6), event("c", 6, 7)],
        [event("a", 5, 8), event("c", 7, 9), event("c", 12, 10), event("b", 20, 11)],
        [event("d", 19, 12), event("b", 21, 13), event("e", 22, 14)],
        [event("a", 3, 15), event("f", 2, 16), event("b", 25, 17), event("e", 23, 18)],
    ]
    put(spark, path, *batches[:2])
    first = run(spark, path, out, checkpoint)
    put(spark, path, *batches[2:])
    second = run(spark, path, out, checkpoint)
    want, counts = plain(batches)
    got = spark.read.parquet(out)
    assert sorted(r.note.n for r in got.collect()) == want
    seen = ingest_counts(spark, first).union(ingest_counts(spark, second)).orderBy("batch_id").collect()
    assert [tuple(r)[1:] for r in seen] == counts
    assert counts[-1][1] == 2 and counts[0][2] == 501  # late ones and copies are there
    assert got.schema["note"].dataType == spark.createDataFrame([], EVENT).schema["note"].dataType
    again = run(spark, path, out, checkpoint)
    assert spark.read.parquet(out).count() == len(want) and not ingest_counts(spark, again).collect()


def test_keys_share_states_and_are_forgotten(spark, monkeypatch):
    monkeypatch.setattr(ingest, "BUCKETS", 8)
    path, out, checkpoint = (new_path(spark, f"t-ingest-buckets-{n}") for n in ("in", "out", "check"))
    rng = random.Random(5)
    batches = [
        [event(f"k{rng.randrange(300)}", max(0, 3 * b + rng.randrange(-3, 4)), 1000 * b + i, i / 20) for i in range(400)]
        for b in range(4)
    ]
    batches += [[event("last", 60, 9001)], [event("last", 61, 9002), event("k1", 61, 9003)]]
    put(spark, path, *batches)
    query = run(spark, path, out, checkpoint)
    want, counts = plain([sorted(rows, key=lambda r: r[1]) for rows in batches])
    assert sorted(r.note.n for r in spark.read.parquet(out).collect()) == want
    assert [tuple(r)[1:] for r in ingest_counts(spark, query).orderBy("batch_id").collect()] == counts
    sizes = [p.stateOperators[0].numRowsTotal for p in query.recentProgress]
    assert max(sizes) <= 3 * 8 and sizes[-1] <= 3 * 2  # a state, and a timer kept under two names


def test_nulls_and_an_empty_file(spark):
    path, out, checkpoint = (new_path(spark, f"t-ingest-null-{n}") for n in ("in", "out", "check"))
    put(spark, path, [], [event(None, None, 1), event(None, None, 1), event("a", None, 2), event("a", 0, 3)])
    run(spark, path, out, checkpoint)
    assert sorted(r.note.n for r in spark.read.parquet(out).collect()) == [1, 2, 3]


def test_a_key_must_outlive_late_copies(spark):
    events = spark.createDataFrame([], EVENT)
    with pytest.raises(ValueError, match="late_days"):
        first_of_key(events, F.col("id"), F.col("timestamp"), 2, 2)
