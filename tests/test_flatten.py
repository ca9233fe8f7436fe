from pyspark.sql import functions as F

from oddlog.operators.flatten import (
    drop_internal,
    field_set_diff,
    flatten,
    json_schema,
    normalise_names,
    parse_json,
    prepare,
    presence_counts,
    project_fill,
)


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def test_objects_become_dotted_names(spark):
    df = frame(spark, "user struct<id:bigint,session:struct<arn:string>>, n int", (((1, ("a",)), 2)), (None, 3))
    flat = flatten(df)
    assert flat.columns == ["user.id", "user.session.arn", "n"]
    assert [tuple(r) for r in flat.orderBy("n").collect()] == [(1, "a", 2), (None, None, 3)]


def test_scalar_arrays(spark):
    df = frame(spark, "i int, x array<string>, y array<int>", (0, [], [1]), (1, ["a", "b"], None), (2, None, []))
    rows = [tuple(r) for r in flatten(df).orderBy("i").collect()]
    assert flatten(df).columns == ["i", "x_count", "x_first", "y_count", "y_first"]
    assert rows == [(0, 0, None, 1, "1"), (1, 2, "a", None, None), (2, None, None, 0, None)]


def test_object_arrays_keep_five(spark):
    df = frame(spark, "x array<struct<k:int,inner:struct<z:string>>>", ([(i, (str(i),)) for i in range(7)],), ([(9, None)],))
    flat = flatten(df)
    assert flat.columns == [f"x[{i}].{n}" for i in range(5) for n in ("k", "inner.z")]
    rows = [r.asDict() for r in flat.orderBy("`x[0].k`").collect()]
    assert [rows[0][f"x[{i}].k"] for i in range(5)] == [0, 1, 2, 3, 4]
    assert rows[1]["x[0].k"] == 9 and rows[1]["x[1].k"] is None


def test_names_with_dots_and_later_name_wins(spark):
    df = frame(spark, "`a.b` int, a struct<b:int,`c.d`:int>", (1, (2, 3)))
    flat = flatten(df)
    assert flat.columns == ["a.b", "a.c.d"]
    assert tuple(flat.first()) == (2, 3)


def test_schema_union_and_malformed_json(spark):
    df = frame(
        spark,
        "j string",
        ('{"a": 1, "b": {"c d": 1.5}}',),
        ('{"a": "s", "l": [1, 2], "o": [{"k": 1}, {"k": 2}]}',),
        ("not json",),
        (None,),
    )
    parsed = parse_json(df, "j")
    assert set(flatten(parsed).columns) >= {"j.a", "j.b.c d", "j.l_count", "j.l_first", "j.o[0].k", "j.o[4].k"}
    rows = flatten(parsed).collect()
    assert rows[0]["j.a"] == "1" and rows[1]["j.a"] == "s"
    assert all(v is None for v in rows[2]) and all(v is None for v in rows[3])


def test_no_json_at_all(spark):
    df = frame(spark, "i int, j string", (1, "nope"))
    assert json_schema(df, "j").fields == []
    assert parse_json(df, "j").first().j is None


def test_aliases_and_collision(spark):
    df = frame(spark, "useragent string, userAgent string, other int", ("low", None, 1), ("low", "Camel", 2))
    rows = normalise_names(df).orderBy("other").collect()
    assert [tuple(r) for r in rows] == [("low", 1), ("Camel", 2)]


def test_drop_internal_keeps_event_time(spark):
    df = frame(spark, "p_row_id string, p_event_time string, port int", ("x", "2024-01-01", 1))
    assert drop_internal(df).columns == ["p_event_time", "port"]


def test_project_fill_and_presence(spark):
    df = frame(spark, "a int, b string", (None, "x"))
    assert tuple(project_fill(df, ["b", "missing", "a"]).first()) == ("x", 0, None)
    counts = presence_counts(df, ["a", "b", "missing"]).first()
    assert (counts.features_found, counts.features_missing) == (1, 2)
    sets = field_set_diff(df, ["a", "missing"]).first()
    assert (sets.common_fields, sets.missing_in_event, sets.missing_in_model) == ([], ["a", "missing"], ["b"])


def test_prepare_without_time_field_adds_none(spark):
    assert prepare(frame(spark, "a int", (1,))).columns == ["a"]


def test_prepare_uses_first_present_time(spark):
    df = frame(spark, "timestamp string, p_event_time string", ("2024-01-01T05:00:00Z", None), ("bad", "2024-01-02T06:00:00Z"))
    assert [(r.hour, r.day_of_week) for r in prepare(df).orderBy(F.col("hour")).collect()] == [(5, 0), (6, 1)]
