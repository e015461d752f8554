import datetime as dt

import pytest
from pyspark.sql import functions as F

from holdfast.functions import dates, text, values


def column(spark, items, expr):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(items)], "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(expr(F.col("v"))).collect()]


def test_date_layouts(spark):
    cases = {
        "1/2/2025": dt.date(2025, 2, 1),
        "14/10/2025": dt.date(2025, 10, 14),
        "10/14/2025": dt.date(2025, 10, 14),
        "2025/10/14": dt.date(2025, 10, 14),
        "2025-1-5": dt.date(2025, 1, 5),
        "3-4-2025": dt.date(2025, 4, 3),
        "4-30-2025": dt.date(2025, 4, 30),
        "30/2/2025": None,
        "13/13/2025": None,
        "0/1/2025": None,
        "2025-10/14": None,
        "25-10-14": None,
        "2025-10-14 10:00": None,
        "bad": None,
        "": None,
        None: None,
    }
    assert column(spark, cases, dates.parse_date) == list(cases.values())


def test_datetime_layouts(spark):
    cases = {
        "2025-10-14": dt.datetime(2025, 10, 14),
        "2025-10-14T12:34:56+02:00": dt.datetime(2025, 10, 14, 12, 34, 56),
        "2025-10-14 12:34:56.987654": dt.datetime(2025, 10, 14, 12, 34, 56),
        "2025-10-14T12:34:56Z": dt.datetime(2025, 10, 14, 12, 34, 56),
        "2025-10-14T07": dt.datetime(2025, 10, 14, 7),
        "2025-10-14 07:08": dt.datetime(2025, 10, 14, 7, 8),
        "2025-1-5 7:08": dt.datetime(2025, 1, 5, 7, 8),
        "2025-1-5T7:08:09": dt.datetime(2025, 1, 5, 7, 8, 9),
        "1/2/2025 7:08:09": dt.datetime(2025, 2, 1, 7, 8, 9),
        "10/14/2025 7:08:09": dt.datetime(2025, 10, 14, 7, 8, 9),
        "2025/10/14 7:08:09": dt.datetime(2025, 10, 14, 7, 8, 9),
        "1/2/2025 7:08": None,
        "1-2-2025 7:08:09": None,
        "2025-1-5": None,
        "2025-10-14 25:00:00": None,
        "1/2/2025": None,
    }
    assert column(spark, cases, dates.parse_datetime) == list(cases.values())


def test_wall_clock_in_any_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        # 02:30 does not exist there on this day.
        got = column(spark, ["2025-03-09 02:30:00"], dates.parse_datetime)
        assert got == [dt.datetime(2025, 3, 9, 2, 30)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_whole_days_floor(spark):
    got = column(
        spark,
        ["2025-01-30 00:00:00", "2025-01-29 10:00:00", "2025-01-30 10:00:00", None],
        lambda v: dates.whole_days(dt.date(2025, 1, 30), v.cast("timestamp_ntz")),
    )
    assert got == [0, 0, -1, None]


def test_numbers(spark):
    cases = {"12": 12.0, " 1.5 ": 1.5, ".5": 0.5, "1e2": 100.0, "n/a": 0.0, "NaN": 0.0, "1_000": 0.0, "1d": 0.0, None: 0.0}
    assert column(spark, cases, values.number_or_zero) == list(cases.values())


def test_first_truthy_and_strip(spark):
    assert column(spark, ["", None, "a"], lambda v: values.first_truthy(v, F.lit("x"))) == ["x", "x", "a"]
    assert column(spark, ["\t a \n", "  ", "b"], values.blank_to_null) == ["a", None, "b"]


@pytest.mark.parametrize("name,expected", [("Ana Maria Ruiz", "AM"), ("ana", "A"), ("", "")])
def test_initials(spark, name, expected):
    assert column(spark, [name], text.initials) == [expected]


def test_reason_label_keeps_unknown(spark):
    assert column(spark, ["plan", "other"], text.reason_label) == ["plan_inadecuado", "other"]
