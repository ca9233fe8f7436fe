import random

import pytest

from oddlog.session import new_path
from oddlog.sources import paging


def brute(rows, size, most_bytes):
    """Page of every key by walking the keys in order."""
    held = {}
    for k, text in rows:
        n, b = held.get(k, (0, 0))
        body = ("" if k is None else f'"k":{k},') + f'"text":"{text}"'
        held[k] = (n + 1, b + len("{" + body + "}"))
    pages, before = {}, 0
    for k in sorted(held, key=lambda k: (k is not None, k)):
        n, b = held[k]
        pages[k] = before // (size * most_bytes)
        before += max(n * most_bytes, b * size)
    return pages


@pytest.mark.parametrize("size, most_bytes", [(7, 10_000), (1000, 150), (1, 1), (10_000, 10_000_000)])
def test_pages_equal_a_walk_over_the_keys(spark, size, most_bytes):
    draw = random.Random(size)
    keys = [None, 5] + [draw.randrange(-40, 40) for _ in range(60)]
    rows = [(draw.choice(keys) if draw.random() < 0.6 else 5, "x" * draw.randrange(30)) for _ in range(400)]
    df = spark.createDataFrame(rows, "k long, text string")
    want = brute(rows, size, most_bytes)
    for keys_per_task in (10, 1_000_000):
        cut = paging.plan_pages(df, "k", size, most_bytes, keys_per_task)
        assert {r.key: r.page for r in cut.keys.collect()} == want
        for lookup in (0, 200_000):  # joined by key, and searched in one value
            got = cut.number(df, lookup=lookup).collect()
            assert sorted(map(repr, ((r.k, r.text, r.page) for r in got))) == sorted(map(repr, ((k, t, want[k]) for k, t in rows)))


def test_pages_as_ranges_cover_every_row_once(spark):
    df = spark.sql("SELECT cast(if(id % 50 = 0, null, id div 3) AS int) AS k, id FROM range(500)")
    cut = paging.plan_pages(df, "k", 40)
    found = [(n, sorted(r.id for r in rows.collect())) for n, rows in cut.each(df)]
    assert [n for n, _ in found] == sorted({n for n, _ in found}) and len(found) > 10
    assert sorted(i for _, ids in found for i in ids) == list(range(500))
    assert {n: len(ids) for n, ids in found} == {r.page: r.n_logs for r in cut.plan.collect()}
    assert all(len(ids) < 40 + 3 for _, ids in found)  # two rows at most beyond the size, as a key is not cut


@pytest.mark.parametrize("kind", ["string", "double", "date", "timestamp", "timestamp_ntz", "decimal(12,3)"])
def test_keys_of_any_kind(spark, kind):
    value = {
        "string": "if(id % 9 = 0, '', chr(cast(40 + id % 300 AS int)))",
        "double": "if(id % 9 = 0, double('NaN'), id / 7)",
        "date": "date_add(date'2024-01-01', cast(id AS int))",
        "decimal(12,3)": "id / 8",
    }.get(kind, "timestamp'2024-03-10 01:02:03.456789' + make_dt_interval(0, cast(id AS int))")
    df = spark.range(300).selectExpr(f"cast({value} AS {kind}) AS `a.key`", "id", "id AS page")
    cut = paging.plan_pages(df, "a.key", 20)
    searched = {r.id: r.page for r in cut.number(df, lookup=200_000).collect()}
    assert searched == {r.id: r.page for r in cut.number(df, lookup=0).collect()} and len(searched) == 300
    assert searched == {r.id: n for n, rows in cut.each(df) for r in rows.collect()}
    assert len(set(searched.values())) >= 10


def test_a_table_is_read_twice_whatever_the_number_of_pages(spark):
    read = spark.sparkContext.accumulator(0)
    source = spark.range(0, 1000, 1, 4).selectExpr("id div 2 AS k", "id")

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    df = source.mapInArrow(counted, source.schema)
    cut = paging.plan_pages(df, "k", 10)
    assert read.value == 1000 and cut.plan.count() == 100
    path = new_path(spark, "t-pages")
    paging.write_pages(df, cut, path)
    assert read.value == 2000
    assert sorted(r.id for r in paging.read_page(spark, path, 7).collect()) == list(range(70, 80))
    assert spark.read.parquet(path).count() == 1000 and read.value == 2000


@pytest.mark.parametrize("lookup", [0, 200_000])
def test_a_row_does_not_carry_the_pages_to_its_number(spark, lookup):
    df = spark.range(0, 3000, 1, 4).selectExpr("id div 2 AS k", "id")
    cut = paging.plan_pages(df, "k", 2)
    numbered = cut.number(df, lookup=lookup)
    plan = numbered._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert {r.id: r.page for r in numbered.collect()} == {i: i // 2 for i in range(3000)}


def test_an_empty_table_has_no_pages(spark):
    df = spark.createDataFrame([], "k long, text string")
    cut = paging.plan_pages(df, "k", 10)
    assert cut.plan.count() == 0 and list(cut.each(df)) == [] and cut.number(df).count() == 0
    assert cut.number(df).columns == ["k", "text", "page"]
    only = spark.createDataFrame([(None, "a"), (None, "b")], "k long, text string")
    cut = paging.plan_pages(only, "k", 1)
    assert [(n, rows.count()) for n, rows in cut.each(only)] == [(0, 2)]
    with pytest.raises(ValueError):
        paging.plan_pages(df, "k", 0)
