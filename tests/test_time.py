import datetime as dt

import pytest
from pyspark.sql import functions as F, types as T

from oddlog.functions import timefeat
from oddlog.functions.text import canonical_text, count_label, eta_label, fixed, rate_label

TEXT = T.StringType()


def one(spark, schema, value, make):
    return spark.createDataFrame([(value,)], f"s {schema}").select(make(F.col("s")).alias("r")).first().r


@pytest.mark.parametrize(
    "text, hour, day",
    [
        ("2024-01-01T12:00:00+05:00", 12, 0),
        ("2024-01-01T12:00:00Z", 12, 0),
        ("2024-01-07 23:59:59.123456", 23, 6),
        ("2024-01-03", 0, 2),
        ("invalid-timestamp", -1, -1),
        ("1700000000", -1, -1),
        ("", None, None),
        (None, None, None),
    ],
)
def test_time_features(spark, text, hour, day):
    assert one(spark, "string", text, timefeat.hour) == hour
    assert one(spark, "string", text, timefeat.day_of_week) == day


def test_numbers_are_not_epochs(spark):
    assert one(spark, "bigint", 1700000000, lambda s: timefeat.hour(s, T.LongType())) == -1


@pytest.mark.parametrize(
    "text, utc",
    [
        ("2024-01-01T12:00:00+05:00", dt.datetime(2024, 1, 1, 7)),
        ("2024-01-01T12:00:00-0330", dt.datetime(2024, 1, 1, 15, 30)),
        ("2024-01-01T12:00:00Z", dt.datetime(2024, 1, 1, 12)),
        ("2024-01-01T12:00:00", dt.datetime(2024, 1, 1, 12)),
        ("2024-01-05", dt.datetime(2024, 1, 5)),
        ("soon", None),
    ],
)
def test_instants_do_not_depend_on_the_session_zone(spark, text, utc):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for name in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", name)
            assert one(spark, "string", text, lambda s: timefeat.instant(s, TEXT)) == utc
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


@pytest.mark.parametrize(
    "last, days",
    [(None, 14), ("2024-02-05T00:00:00Z", 1), ("2024-02-03T12:00:00Z", 2), ("2024-01-01T00:00:00Z", 14), ("2024-02-09T00:00:00Z", 1), ("?", 14)],
)
def test_incremental_window(spark, last, days):
    make = lambda s: timefeat.window_days(timefeat.instant(s, TEXT), timefeat.moment("2024-02-05 00:00:00"), F.lit(14))
    assert one(spark, "string", last, make) == days


@pytest.mark.parametrize(
    "value, digits, text", [(0.0625, 3, "0.063"), (-1.25, 1, "-1.3"), (3.0, 1, "3.0"), (1e25, 1, "10000000000000000905969664.0"), (None, 1, None)]
)
def test_fixed_decimals(spark, value, digits, text):
    got = one(spark, "double", value, lambda s: fixed(s, digits))
    assert got == text or (value == 1e25 and float(got) == value)


def test_labels(spark):
    assert one(spark, "bigint", 1_234_567, count_label) == "1.2M"
    assert one(spark, "bigint", 3_400, count_label) == "3.4k"
    assert one(spark, "bigint", 999, count_label) == "999"
    assert one(spark, "double", 0.0, lambda s: rate_label(F.lit(5), s)) == "calculating..."
    assert one(spark, "double", 60.0, lambda s: rate_label(F.lit(5), s)) == "5 events/min"
    assert one(spark, "double", 10.0, lambda s: eta_label(F.lit(60.0), s)) == "9 minutes"
    assert one(spark, "double", 100.0, lambda s: eta_label(F.lit(60.0), s)) == "unknown"


def test_canonical_text(spark):
    assert one(spark, "boolean", True, lambda s: canonical_text(s, T.BooleanType())) == "True"
    assert one(spark, "double", 443.0, lambda s: canonical_text(s, T.DoubleType())) == "443"
    assert one(spark, "double", 1.5, lambda s: canonical_text(s, T.DoubleType())) == "1.5"
    assert one(spark, "int", 443, lambda s: canonical_text(s, T.IntegerType())) == "443"


def test_zoned_timestamps_are_read_in_utc_whatever_the_session(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for other in ("UTC", "America/New_York", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", other)
            at = spark.sql("SELECT timestamp '2024-01-01 03:30:00+00:00' AS s")
            kind = T.TimestampType()
            row = at.select(timefeat.hour(F.col("s"), kind).alias("h"), timefeat.instant(F.col("s"), kind).alias("i")).first()
            assert (row.h, row.i) == (3, dt.datetime(2024, 1, 1, 3, 30))
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
