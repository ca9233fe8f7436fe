import math

import numpy as np
import pytest
from pyspark.sql import Window, functions as F, types as T

from oddlog.operators import detect as detection
from oddlog.operators.detect import Scorer, alerts, detect, score_requests
from oddlog.operators.forest import share_forest
from oddlog.operators.reports import threshold_sweep
from oddlog.operators.requests import read_requests
from oddlog.operators.route import route
from oddlog.operators.synth import synthesise
from oddlog.plans import train
from oddlog.session import new_path
from oddlog.sources.logs import read_json_logs
from oddlog.sources.models import Model
from oddlog.streaming.score import detect_stream, read_events, write_results

EVENT = "p_event_time string, eventsource string, eventName string, userIdentity struct<type:string>, bytes bigint, src_port int, p_row_id bigint"
IAM, CONFIG = "AWS IAM", "AWS Config"


def make_logs(spark, n=4000):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(n):
        iam = i % 4 != 0
        stamp = f"2024-01-{1 + i % 28:02d}T{int(rng.normal(12, 3)) % 24:02d}:00:00Z"
        rows.append(
            (
                stamp,
                "iam.amazonaws.com" if iam else "config.amazonaws.com",
                str(rng.choice(["GetUser", "ListRoles", "PutUser"], p=[0.7, 0.295, 0.005])),
                (None if rng.random() < 0.2 else str(rng.choice(["Root", "Role"], p=[0.1, 0.9])),),
                int(rng.normal(1000, 50)),
                int(rng.choice([22, 443])),
                i,
            )
        )
    return spark.createDataFrame(rows, EVENT)


@pytest.fixture(scope="module")
def logs(spark):
    return make_logs(spark)


@pytest.fixture(scope="module")
def model(logs):
    named = logs.withColumn("log_type", F.when(F.col("eventsource").startswith("iam"), IAM).otherwise(CONFIG))
    return train.fit(named, row_key=["p_row_id"])


@pytest.fixture(scope="module")
def scorer(model):
    return Scorer(model)


def event(spark, **fields):
    values = {f.name: fields.get(f.name) for f in T.StructType.fromDDL(EVENT).fields}
    return spark.createDataFrame([tuple(values.values())], EVENT)


def test_model_tables(model):
    models = {r.log_type: r for r in model.models.collect()}
    assert models[IAM].training_samples == 3000 and models[CONFIG].training_samples == 1000
    assert set(models[IAM].categorical_features) == {"eventName", "userIdentity.type", "src_port", "p_event_time"}
    assert set(models[IAM].numerical_features) == {"hour", "day_of_week", "bytes"}
    assert models[IAM].anomaly_rate == pytest.approx(0.1, abs=0.01)
    assert models[IAM].params["random_state"] == "42"


def test_planted_outliers_score_lowest(spark, scorer, logs):
    odd = event(spark, p_event_time="2024-01-03T03:00:00Z", eventsource="iam.amazonaws.com", eventName="PutUser",
                userIdentity=("Root",), bytes=5000, src_port=22, p_row_id=-1)
    found = detect(logs.unionByName(odd), scorer, keep=("p_row_id",))
    below = found.where("log_type = 'AWS IAM'").select(F.percent_rank().over(Window.orderBy("anomaly_score")).alias("r"), "p_row_id")
    assert below.where("p_row_id = -1").first().r < 0.02


def test_result_row(spark, scorer):
    row = detect(
        event(spark, p_event_time="2024-01-03T12:00:00Z", eventsource="IAM.amazonaws.com", eventName="PutUser", bytes=1500),
        scorer,
        threshold=10.0,
    ).first()
    assert row.log_type == IAM and row.is_anomaly and row.error is None and row.anomaly_threshold == 10.0
    by_name = {d.feature: d for d in row.feature_deviations}
    assert by_name["eventName"].type == "categorical" and by_name["eventName"].deviation_level == "extremely_rare"
    assert by_name["bytes"].z_score > 3 and by_name["bytes"].deviation_level == "extreme"
    assert "src_port" not in by_name and "userIdentity.type" not in by_name  # absent fields have no deviation
    assert row.explanation.startswith("This event appears anomalous (score: ")
    assert "eventName (rarity: 1.00)" in row.explanation or "eventName (rarity: 0.99)" in row.explanation
    info = row.model_info
    assert info.features_used_count == info.features_found_in_event + info.features_missing_from_event
    assert info.training_samples == 3000


def test_unseen_category_and_missing_fields_are_scored(spark, scorer):
    row = detect(event(spark, eventsource="iam.amazonaws.com", eventName="NeverSeen"), scorer).first()
    assert row.error is None and not math.isnan(row.anomaly_score)
    (only,) = row.feature_deviations
    assert (only.feature, only.frequency, only.rarity_score) == ("eventName", 0, 1.0)


def test_bad_timestamp_is_scored_with_sentinels(spark, scorer):
    row = detect(event(spark, eventsource="iam.amazonaws.com", p_event_time="invalid-timestamp"), scorer).first()
    found = {d.feature: d.value for d in row.feature_deviations}
    assert found == {"hour": "-1.0", "day_of_week": "-1.0", "p_event_time": "invalid-timestamp"}
    assert row.model_info.features_found_in_event == 3


def test_empty_event_with_given_log_type(spark, scorer):
    df = spark.createDataFrame([(IAM,), ("Invalid Model",), (None,)], "asked string")
    rows = {r.asked: r for r in detect(df, scorer, explicit="asked", keep=("asked",)).collect()}
    assert rows[IAM].error is None and rows[IAM].explanation == "No feature deviations calculated for analysis."
    assert rows["Invalid Model"].error == "No model available for log type: Invalid Model"
    assert rows["Invalid Model"].anomaly_score is None and rows["Invalid Model"].feature_deviations is None
    assert rows[None].error == "No model available for log type: None"


def test_scores_do_not_depend_on_partitioning(scorer, logs):
    a = detect(logs, scorer, keep=("p_row_id",)).select("p_row_id", "anomaly_score").collect()
    b = detect(logs.repartition(13).orderBy(F.desc("bytes")), scorer, keep=("p_row_id",)).select("p_row_id", "anomaly_score").collect()
    assert dict(a) == dict(b)


def test_forests_scored_in_turns_give_the_same(monkeypatch, model, scorer, logs):
    want = dict(detect(logs, scorer, keep=("p_row_id",)).select("p_row_id", "anomaly_score").collect())
    monkeypatch.setattr(detection, "FOREST_ROWS", 10)
    other = event(logs.sparkSession, eventsource="unknown", p_row_id=-5)
    got = detect(logs.unionByName(other), Scorer(model), keep=("p_row_id",)).select("p_row_id", "anomaly_score").collect()
    assert dict(got) == {**want, -5: None}


def test_shuffled_lookup_gives_the_same(monkeypatch, model, scorer, logs):
    want = dict(detect(logs, scorer, keep=("p_row_id",)).select("p_row_id", "anomaly_score").collect())
    large = Scorer(model)
    large.small = False
    assert dict(detect(logs, large, keep=("p_row_id",)).select("p_row_id", "anomaly_score").collect()) == want


def test_planning_a_detection_needs_no_job(scorer, logs):
    detect(logs, scorer).limit(1).collect()
    tracker = logs.sparkSession.sparkContext.statusTracker()
    logs.sparkSession.sparkContext.setJobGroup("planning", "")
    detect(logs, scorer)._jdf.queryExecution().executedPlan()
    assert not tracker.getJobIdsForGroup("planning")
    logs.sparkSession.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_corrupt_text_is_an_error_of_its_own(spark, scorer, tmp_path):
    (tmp_path / "x.json").write_text('{"eventsource": "iam.amazonaws.com", "bytes": 7}\n{"eventsource": "iam.amaz\n')
    schema = T.StructType.fromDDL(EVENT)
    read = read_json_logs(spark, str(tmp_path), schema, corrupt="_corrupt_record").cache()
    rows = detect(read, scorer, keep=("bytes",)).collect()
    assert {(r.bytes, r.error) for r in rows} == {(7, None), (None, "Invalid JSON in request body")}


def test_requests_are_answered_or_kept_with_their_error(spark, scorer):
    bodies = [
        (1, '{"event_data":{"eventsource":"iam.amazonaws.com","bytes":900}}'),
        (2, '{"event_data":{"eventsource":"iam.amazonaws.com"},"log_type":"none such","anomaly_threshold":-0.5}'),
        (3, "{"), (4, "{}"), (5, '{"event_data":{"bytes":1},"anomaly_threshold":"x"}'),
    ]
    asked = spark.createDataFrame(bodies, "id int, body string")
    got = {r.id: r for r in score_requests(asked, "body", T.StructType.fromDDL(EVENT), scorer, ("id",)).collect()}
    assert got[1].error is None and got[1].anomaly_threshold == -0.2 and got[1].explanation
    assert [got[i].error for i in (2, 3, 4, 5)] == [
        "No model available for log type: none such", "Invalid JSON in request body", "Missing 'event_data' in request",
        "anomaly_threshold must be a number",
    ]


def test_a_forest_of_another_selection_is_refused(spark, scorer):
    nodes = [("t", 0, 1, 9, 0.5, None), ("t", 0, 2, None, None, 1.0), ("t", 0, 3, None, None, 1.0)]
    forest = spark.createDataFrame(nodes, "log_type string, tree int, node int, feature int, threshold double, path_length double")
    with pytest.raises(ValueError, match="splits on feature 9"):
        share_forest(forest, 3)


def test_thresholds_are_monotone(scorer, logs):
    sweep = threshold_sweep(detect(logs, scorer)).orderBy("threshold").collect()
    assert [r.threshold for r in sweep] == [-0.5, -0.3, -0.1, 0.0]
    assert [r.anomalies for r in sweep] == sorted(r.anomalies for r in sweep)
    assert sweep[-1].anomaly_rate == pytest.approx(0.1, abs=0.02)


def test_detection_is_map_only(scorer, logs, tmp_path):
    logs.write.parquet(str(tmp_path / "logs"))
    stored = logs.sparkSession.read.parquet(str(tmp_path / "logs"))
    plan = detect(stored, scorer)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "SortMergeJoin" not in plan
    assert "BroadcastExchange" in plan


def test_saved_model_gives_the_same_scores(spark, model, scorer, logs, tmp_path):
    model.save(str(tmp_path / "m"))
    model.save(str(tmp_path / "m"))  # overwriting leaves one copy
    again = Model.load(spark, str(tmp_path / "m"))
    assert again.forest.count() == model.forest.count()
    a = detect(logs, scorer, keep=("p_row_id",)).select("p_row_id", "anomaly_score", "explanation").collect()
    b = detect(logs, again, keep=("p_row_id",)).select("p_row_id", "anomaly_score", "explanation").collect()
    assert sorted(a) == sorted(b)


def test_stream_equals_batch(spark, scorer, logs):
    path = new_path(spark, "t-events")
    logs.repartition(3).write.json(path)
    stream = detect_stream(read_events(spark, path, logs.schema), scorer, -0.02, keep=("p_row_id",))
    out = new_path(spark, "t-out")
    write_results(stream, out, new_path(spark, "t-check"), only_alerts=True).awaitTermination()
    want = alerts(detect(logs, scorer, -0.02, keep=("p_row_id",)))
    cols = ["p_row_id", "anomaly_score", "explanation"]
    got = spark.read.schema(stream.schema).parquet(out).select(cols).collect()
    assert got and sorted(got) == sorted(want.select(cols).collect())


def test_small_log_types_are_reported_not_trained(spark):
    df = spark.range(150).selectExpr("if(id < 30, 'few', 'many') AS log_type", "id % 5 AS kind", "id AS n", "cast(id AS string) AS p_x")
    model = train.fit(df, row_key=["n"], n_trees=5)
    report = {r.log_type: r for r in train.training_report(df, model).collect()}
    assert report["few"].status == "FAILED - insufficient data" and report["many"].status == "SUCCESS"
    assert report["many"].n_numerical == 1


def test_routing_order(spark):
    schema = "eventsource string, severity string, actor string, asked string"
    df = spark.createDataFrame(
        [
            ("IAM.AmazonAWS.com", "x", None, None),
            (None, "x", "me", None),
            ("other", None, "me", None),
            (None, None, None, None),
            ("iam.amazonaws.com", None, None, "anything"),
        ],
        schema,
    )
    got = [r[0] for r in df.select(route(df, [IAM, "alert_logs", "audit_logs"], "asked")).collect()]
    assert got == [IAM, "alert_logs", "audit_logs", None, "anything"]
    assert [r[0] for r in df.select(route(df, []))  .collect()] == [None] * 5


def test_nested_actor_is_not_audit_like(spark):
    from oddlog.operators.flatten import flatten

    df = flatten(spark.createDataFrame([((1,),)], "actor struct<id:int>"))
    assert df.select(route(df, ["audit_logs"])).first()[0] is None


def test_requests(spark):
    bodies = [
        '{"event_data": {"a": 1}, "log_type": "X", "anomaly_threshold": -0.3}',
        '{"event_data": {"a": 1}, "anomaly_threshold": 0}',
        '{"event_data": {"a": 2}}',
        "{}",
        '{"invalid_field": 1}',
        '{"event_data": {"a": 1}, "anomaly_threshold": "invalid"}',
        "{broken",
        None,
    ]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, body string")
    rows = read_requests(df, "body", T.StructType.fromDDL("a bigint")).orderBy("i").collect()
    assert [r.error is None for r in rows] == [True, True, True, False, False, False, False, False]
    assert [r.anomaly_threshold for r in rows[:3]] == [-0.3, 0.0, -0.2]
    assert rows[0].log_type == "X" and rows[2].event_data.a == 2
    assert "event_data" in rows[3].error and "threshold" in rows[5].error and "JSON" in rows[6].error


def test_synthetic_events_follow_the_baseline(spark, model, scorer):
    ids = spark.range(4000).selectExpr("id", "'AWS IAM' AS log_type", "id % 2 = 1 AS anomalous")
    rows = synthesise(ids, model)
    stats = {r.feature: r for r in model.features.where("log_type = 'AWS IAM'").collect()}
    normal = rows.where("NOT anomalous AND feature = 'bytes'").agg(F.avg("number_value"), F.max("number_value")).first()
    assert normal[0] == pytest.approx(stats["bytes"]["mean"], abs=stats["bytes"]["std"] * 0.2)
    assert normal[1] <= stats["bytes"]["mean"] + 2 * stats["bytes"]["std"]
    rare = rows.where("anomalous AND feature = 'eventName'").agg(F.avg((F.col("text_value") == "PutUser").cast("double"))).first()[0]
    assert rare == pytest.approx(0.7, abs=0.05)
    hours = rows.where("feature = 'hour'").agg(F.min("number_value"), F.max("number_value")).first()
    assert 0 <= hours[0] and hours[1] <= 23
    again = synthesise(ids.repartition(5), model)
    assert again.exceptAll(rows).isEmpty()


def test_fields_named_like_internal_columns(spark):
    """Fields called offset, score, tree, p or psi are ordinary features."""
    df = spark.range(400).selectExpr(
        "'t' AS log_type", "id", "id % 17 AS `offset`", "id % 23 AS score", "concat('v', id % 5) AS tree", "id % 3 AS p",
        "id % 11 AS psi", "id % 7 AS text_0", "cast(id % 2 AS string) AS error",
    )
    model = train.fit(df, row_key=["id"], n_trees=10)
    names = {r.feature for r in model.features.collect()}
    assert names == {"offset", "score", "tree", "p", "psi", "text_0", "error"}
    rows = detect(df.withColumnRenamed("log_type", "kind"), model, explicit="kind", keep=("id",)).collect()
    assert len(rows) == 400 and all(r.error is None and len(r.feature_deviations) == 7 for r in rows)
    values = {d.feature: d.value for d in next(r for r in rows if r.id == 42).feature_deviations}
    assert values == {"offset": "8.0", "score": "19.0", "tree": "v2", "p": "0.0", "psi": "9.0", "text_0": "0.0", "error": "0"}


def test_nothing_to_train(spark):
    df = spark.range(50).selectExpr("'t' AS log_type", "id % 5 AS x")
    model = train.fit(df)
    assert train.training_report(df, model).first().status == "FAILED - insufficient data"
    row = detect(df.withColumnRenamed("log_type", "kind"), model, explicit="kind").first()
    assert row.error == "No model available for log type: t" and row.is_anomaly is None
