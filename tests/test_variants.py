import json

import pytest

from oddlog.operators import variants


def logs(spark, *rows):
    texts = [(i, r if isinstance(r, (str, type(None))) else json.dumps(r)) for i, r in enumerate(rows)]
    return spark.createDataFrame(texts, "id int, body string")


def test_a_stated_null_time_is_not_an_absent_one(spark):
    df = logs(
        spark,
        {"p_event_time": None, "timestamp": "2024-01-01T05:00:00Z"},
        {"timestamp": "2024-01-01T05:00:00+05:00"},
        {"other": 1},
        {"p_event_time": ""},
        {"p_event_time": "soon"},
        {"p_event_time": 1700000000},
        {"createdAt": "2024-01-07 23:59:59"},
        None,
        "no json",
        "[1]",
    )
    got = [(r.hour, r.day_of_week) for r in variants.with_variant_time(df, "body").orderBy("id").collect()]
    nothing = (None, None)
    assert got == [(-1, -1), (5, 0), nothing, nothing, (-1, -1), (-1, -1), (23, 6), nothing, nothing, nothing]


def test_null_fields_name_what_is_stated(spark):
    df = logs(spark, {"a": None, "b": {"c": None, "d": 1}}, {"b": {"c": 2}}, {"b": None}, {"l": [{"k": None}]}, {})
    fields = variants.fields_of(df, "body")
    got = [sorted(r.null_fields) for r in variants.null_fields(df, "body", fields).orderBy("id").collect()]
    assert got == [["a", "b.c"], [], ["b"], ["l[0].k"], []]


def test_flat_columns_and_types(spark):
    df = logs(
        spark,
        {"n": 1, "x": 1.5, "t": "a", "f": True, "mixed": 1, "user": {"name": "u", "deep": {"er": "z"}}, "tags": [True, 2], "empty": []},
        {"n": None, "x": 2, "t": None, "mixed": "two", "user": "root", "items": [{"k": i} for i in range(7)], "tags": [], "only": None},
        {"items": ["plain"], "user": [5], "none": {}},
    )
    got = variants.flatten_variant(df, "body").orderBy("id")
    types = dict(got.dtypes)
    assert (types["n"], types["x"], types["f"], types["mixed"], types["user"], types["only"]) == ("bigint", "double", "boolean", "string", "string", "string")
    a, b, e = got.collect()
    assert (a.n, a.x, a.f, a.mixed, a["user.name"], a["user.deep.er"], a.user) == (1, 1.5, True, "1", "u", "z", None)
    assert (a.tags_count, a.tags_first, b.tags_count, b.tags_first, a.empty_count, e.tags_count) == (2, "True", 0, None, 0, None)
    assert (b.n, b.x, b.mixed, b.user, b["user.name"]) == (None, 2.0, "two", "root", None)
    assert [b[f"items[{i}].k"] for i in range(5)] == [0, 1, 2, 3, 4] and "items[5].k" not in got.columns
    assert (e.items_count, e.items_first, b.items_count, e.user_count, e.user_first, e.user) == (1, "plain", None, 1, "5", None)
    assert not {"none", "none_count", "items[0]", "body"} & set(got.columns)


def test_names_that_no_path_can_spell(spark):
    names = ['a"b', "a'b", "a?b", "a.b", "a b", "", "é", "a\\b", "$", "a[0]", "*", "`"]
    df = logs(spark, {n: i for i, n in enumerate(names)}, {"in": {n: i for i, n in enumerate(names)}})
    first, second = variants.flatten_variant(df, "body").orderBy("id").collect()
    for i, n in enumerate(names):
        assert first[n] == i and second[f"in.{n}"] == i, n


def test_clashing_names(spark):
    df = logs(spark, {"a": {"b": 1}}, {"a.b": 2}, {"id": 9}).withColumnRenamed("body", "a text")
    got = variants.flatten_variant(df, "a text").orderBy("id").collect()
    assert [r["a.b"] for r in got] == ["1", "2", None] and [r.id for r in got] == [0, 1, 2]


@pytest.mark.parametrize("rows", [[], [None], ["[]", "3", ""], ["{}"]])
def test_no_fields(spark, rows):
    df = logs(spark, *rows) if rows else logs(spark, "{}").limit(0)
    assert variants.fields_of(df, "body") == []
    assert variants.flatten_variant(df, "body").columns == ["id"]
    assert [r.null_fields for r in variants.null_fields(df, "body", []).collect()] == [[]] * len(rows)
