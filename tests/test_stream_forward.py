import pytest
from pyspark.sql import functions as F

from oddlog.session import new_path
from oddlog.streaming.forward import deliver, forward_alerts, forwarded, ledger

RESULT = "event_id bigint, is_anomaly boolean, explanation string"


def results(spark, *ids):
    return spark.createDataFrame([(i, i % 3 == 0, f"event {i}") for i in ids], RESULT)


def stream(spark, path):
    return spark.readStream.schema(RESULT).option("maxFilesPerTrigger", 1).parquet(path)


def seen(spark, out):
    return sorted(r.event_id for r in forwarded(spark, out, spark.createDataFrame([], RESULT).schema).collect())


def test_a_replayed_batch_writes_nothing_twice(spark):
    path, out, checkpoint = (new_path(spark, f"t-forward-{n}") for n in ("in", "out", "check"))
    sent = []
    for part in (range(10), range(10, 20), range(20, 30)):
        results(spark, *part).coalesce(1).write.mode("append").parquet(path)
    forward_alerts(stream(spark, path), out, checkpoint, "siem", lambda rows, n: sent.append((n, rows.count()))).awaitTermination()
    want = [i for i in range(30) if i % 3 == 0]
    assert seen(spark, out) == want and sent == [(0, 4), (1, 3), (2, 3)]
    # the checkpoint is lost: every batch comes again, under the same numbers
    forward_alerts(stream(spark, path), out, checkpoint + "-2", "siem", lambda rows, n: sent.append((n, rows.count()))).awaitTermination()
    assert seen(spark, out) == want and len(sent) == 3
    assert {(r.query, r.batch, r.alerts) for r in ledger(spark, out).collect()} == {("siem", 0, 4), ("siem", 1, 3), ("siem", 2, 3)}


def test_a_batch_without_its_ledger_row_is_unseen_and_written_again(spark):
    out = new_path(spark, "t-forward-crash")

    def crash(rows, number):
        raise OSError("the other system is gone")

    with pytest.raises(OSError):
        deliver(results(spark, 3, 6), 0, out, "siem", crash)
    assert seen(spark, out) == []
    assert deliver(results(spark, 3, 6), 0, out, "siem") and seen(spark, out) == [3, 6]
    assert not deliver(results(spark, 3, 6), 0, out, "siem") and seen(spark, out) == [3, 6]


def test_streams_are_told_apart_and_empty_batches_count(spark):
    out = new_path(spark, "t-forward-two")
    assert seen(spark, out) == []
    assert deliver(results(spark, 3), 0, out, "one") and deliver(results(spark, 9), 0, out, "two")
    assert deliver(results(spark, 3).where(F.lit(False)), 1, out, "one") and seen(spark, out) == [3, 9]
    assert ledger(spark, out).where("batch = 1").first().alerts == 0
