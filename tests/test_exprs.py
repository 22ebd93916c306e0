import datetime as dt

from pyspark.sql import functions as F

from ledgerlens.functions import exprs as X


def test_week_label_monday_to_sunday_across_year_end(spark):
    df = spark.createDataFrame(
        [(dt.datetime(2025, 4, 20, 18, 3, 9),), (dt.datetime(2025, 4, 21),), (dt.datetime(2025, 1, 1),)],
        "ts timestamp_ntz")
    got = [r[0] for r in df.select(X.week_label("ts")).collect()]
    assert got == ["2025-04-14/2025-04-20", "2025-04-21/2025-04-27", "2024-12-30/2025-01-05"]


def test_month_label(spark):
    df = spark.createDataFrame([(dt.datetime(2025, 2, 3, 4, 5),)], "ts timestamp_ntz")
    assert df.select(X.month_label("ts")).first()[0] == "2025-02"


def test_whole_days_floor_negative(spark):
    df = spark.createDataFrame([(dt.datetime(2025, 1, 2, 18), dt.datetime(2025, 1, 2, 0)),
                                (dt.datetime(2025, 1, 1), dt.datetime(2025, 1, 3, 23)),
                                (dt.datetime(2025, 1, 1), None)], "a timestamp_ntz, b timestamp_ntz")
    assert [r[0] for r in df.select(X.whole_days("a", "b")).collect()] == [-1, 2, None]


def test_guarded_ratio_zero_and_null(spark):
    df = spark.createDataFrame([(5.0, 0.0), (5.0, 2.0), (5.0, None)], "n double, d double")
    got = [r[0] for r in df.select(X.guarded_ratio("n", "d", 100.0)).collect()]
    assert got == [0.0, 250.0, None]


def test_safe_division_scalar_rules(spark):
    df = spark.createDataFrame([(None, 2.0), (1.0, 0.0), (1.0, None), (3.0, 2.0)], "n double, d double")
    assert [r[0] for r in df.select(X.safe_division("n", "d")).collect()] == [0.0, 0.0, 0.0, 1.5]


def test_kpi_text_formats(spark):
    df = spark.createDataFrame([(1234567.891,)], "x double")
    r = df.select(X.format_kpi("x", "amount"), X.format_kpi(F.lit(12.345), "percent"),
                  X.format_kpi(F.lit(2.5), "multiple"), X.format_kpi(F.lit(3.0), "days")).first()
    assert tuple(r) == ("1,234,567.89 SAR", "12.35%", "2.50x", "3.00 Days")
    assert df.select(X.format_kpi(F.lit(None).cast("double"), "amount")).first()[0] == "-"
    assert df.select(X.format_kpi(F.lit(1234.125), "percent")).first()[0] == "1234.12%"


def test_whole_days_ignores_session_time_zone(spark):
    df = spark.createDataFrame([(dt.datetime(1995, 3, 30), dt.datetime(1995, 4, 6)),
                                (dt.datetime(1995, 3, 30, 18), dt.datetime(1995, 4, 6, 6))],
                               "a timestamp_ntz, b timestamp_ntz")
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")  # daylight time began 1995-04-02
    try:
        got = [r[0] for r in df.select(X.whole_days("a", "b")).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == [7, 6]
