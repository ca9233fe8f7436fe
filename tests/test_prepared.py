"""The model for single events against the scorer for tables: the same rows, bit for bit."""

import pytest
from pyspark.sql import functions as F, types as T

from oddlog.operators import prepared as prepared_module
from oddlog.operators.detect import Scorer, detect, score_requests
from oddlog.operators.prepared import Prepared
from oddlog.plans import train
from oddlog.sources.models import Model
from test_detect import CONFIG, EVENT, IAM, make_logs


@pytest.fixture(scope="module")
def logs(spark):
    return make_logs(spark, 2000)


@pytest.fixture(scope="module")
def model(logs):
    named = logs.withColumn("log_type", F.when(F.col("eventsource").startswith("iam"), IAM).otherwise(CONFIG))
    return train.fit(named, row_key=["p_row_id"], n_trees=30)


@pytest.fixture(scope="module")
def both(model):
    return Scorer(model), Prepared(model)


def rows_of(df):
    return sorted(map(repr, df.collect()))


def test_ten_thousand_events_are_scored_alike(both, spark):
    many = make_logs(spark, 10_000)
    odd = many.where("p_row_id % 50 = 0").withColumns({"bytes": F.lit(None).cast("bigint"), "eventName": F.lit("Never seen")})
    many = many.unionByName(odd).withColumn("eventsource", F.when(F.col("p_row_id") % 13 > 0, F.col("eventsource")))
    scorer, prepared = both
    assert rows_of(detect(many, prepared, keep=("p_row_id",))) == rows_of(detect(many, scorer, keep=("p_row_id",)))


def test_no_join_no_python_and_no_job_at_planning(both, spark, logs):
    prepared = both[1]
    spark.sparkContext.setJobGroup("planning", "planning")
    found = detect(logs, prepared, keep=("p_row_id",))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("planning")
    assert not any(word in plan for word in ("Join", "Python", "Arrow", "Exchange"))
    spark.sparkContext.setJobGroup("later", "later")


@pytest.mark.parametrize("drop", [(), ("bytes",), ("eventName", "src_port"), ("userIdentity", "p_event_time")])
def test_single_events_and_absent_fields(both, spark, drop):
    schema = T.StructType([f for f in T.StructType.fromDDL(EVENT).fields if f.name not in drop])
    full = {"p_event_time": "no time", "eventsource": "IAM.amazonaws.com", "eventName": "PutUser", "userIdentity": {"type": None}, "bytes": 5000, "src_port": 443, "p_row_id": 1}
    one = both[1].events([{k: v for k, v in full.items() if k not in drop}], schema)
    wanted = rows_of(detect(one, both[0], 0.1, keep=("p_row_id",)))
    for _ in range(2):  # the second time with the columns of the first
        assert rows_of(detect(one, both[1], 0.1, keep=("p_row_id",))) == wanted


def test_given_and_unknown_log_types(both, spark):
    schema = T.StructType.fromDDL(f"{EVENT}, stated string")
    events = both[1].events([{"stated": name, "p_row_id": i} for i, name in enumerate([CONFIG, "No Such Model", None])], schema)
    found = {r.p_row_id: r for r in detect(events, both[1], explicit="stated", keep=("p_row_id",)).collect()}
    assert found[0].error is None and found[0].anomaly_score is not None
    assert found[1].error == "No model available for log type: No Such Model" and found[2].error.endswith("None")
    assert found[1].anomaly_score is found[1].is_anomaly is found[1].explanation is None
    assert rows_of(detect(events, both[1], explicit="stated")) == rows_of(detect(events, both[0], explicit="stated"))


def test_requests_take_either(both, spark):
    bodies = ['{"event_data": {"eventName": "GetUser", "eventsource": "iam.amazonaws.com"}}', '{"event_data": {}, "log_type": "AWS Config"}', "{", "{}"]
    asked = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "id int, body string")
    schema = T.StructType.fromDDL("eventName string, eventsource string, p_event_time string")
    assert rows_of(score_requests(asked, "body", schema, both[1], ("id",))) == rows_of(score_requests(asked, "body", schema, both[0], ("id",)))


def test_a_choice_of_log_types(both, model, logs):
    one = Prepared(model, [CONFIG])
    found = detect(logs, one, keep=("p_row_id",))
    assert one.log_types == [CONFIG]
    known = rows_of(found.where(F.col("log_type") == CONFIG))
    assert known and known == rows_of(detect(logs, both[0], keep=("p_row_id",)).where(F.col("log_type") == CONFIG))
    assert found.where("log_type is null and error is null").count() == 0


def test_what_does_not_fit_is_refused(model, monkeypatch):
    monkeypatch.setattr(prepared_module, "NODE_ROWS", 10)
    with pytest.raises(ValueError, match="too many"):
        Prepared(model)


def test_an_empty_model_answers_with_errors(spark, model, logs):
    empty = Prepared(Model(*(getattr(model, n).limit(0) for n in ("models", "features", "values", "forest"))))
    rows = detect(logs.limit(3), empty).collect()
    assert len(rows) == 3 and all(r.error and r.anomaly_score is None for r in rows)
