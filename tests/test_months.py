from datetime import date, datetime

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tripledger.functions import months
from tripledger.functions.columns import moment


def test_ranges_are_inclusive_and_cross_years():
    assert months.months_between("2023-01", "2023-05") == [(2023, m) for m in range(1, 6)]
    assert months.months_between("2022-11", "2023-02") == [(2022, 11), (2022, 12), (2023, 1), (2023, 2)]
    assert months.months_between("2023-04", "2023-04") == [(2023, 4)]


@pytest.mark.parametrize("text", ["2023-13", "2023-00", "2023-1", "23-01", "2023/01", "", "2023-01-01", "2023-01\n"])
def test_malformed_months_are_rejected(text):
    with pytest.raises(ValueError, match="YYYY-MM"):
        months.month_bounds(text, "2023-05")
    with pytest.raises(ValueError, match="YYYY-MM"):
        months.month_bounds("2023-01", text)


def test_reversed_and_future_ranges_are_rejected():
    with pytest.raises(ValueError, match="after"):
        months.month_bounds("2023-05", "2023-01")
    with pytest.raises(ValueError, match="future"):
        months.month_bounds("2023-01", "2023-06", today=date(2023, 5, 31))
    assert months.month_bounds("2023-05", "2023-05", today=date(2023, 5, 1))[1] == date(2023, 5, 1)


@given(st.integers(1990, 2020), st.integers(1, 12), st.integers(0, 60))
def test_month_list_steps_by_one(year, month, extra):
    steps = [date(year, month, 1)]
    for _ in range(extra):
        steps.append(months.next_month(steps[-1]))
    first, last = (f"{d.year}-{d.month:02d}" for d in (steps[0], steps[-1]))
    assert months.months_between(first, last) == [(d.year, d.month) for d in steps]


def test_spine_rows(spark):
    rows = months.month_spine(spark, "2022-11", "2023-02").orderBy("month").collect()
    assert [(r.month, r.year, r.month_number) for r in rows] == [
        (date(2022, 11, 1), 2022, 11), (date(2022, 12, 1), 2022, 12),
        (date(2023, 1, 1), 2023, 1), (date(2023, 2, 1), 2023, 2),
    ]


def test_month_text_check_on_rows(spark):
    texts = ["2023-01", "2023-12", "2023-13", "2023-1", "x2023-01", "2023-011", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.t for r in df.where(months.is_month_text("t")).collect()] == ["2023-01", "2023-12"]


def test_calendar_range_equals_year_and_month_functions(spark):
    stamps = [datetime(2022, 12, 31, 23, 59, 59), datetime(2023, 1, 1), datetime(2023, 5, 31, 23, 59, 59, 999999),
              datetime(2023, 6, 1), datetime(2024, 1, 1), None]
    df = spark.createDataFrame([(s,) for s in stamps], "ts timestamp_ntz").select(F.col("ts").cast("timestamp"))
    fast = df.where(months.in_months_of_year("ts", 2023, 1, 5)).count()
    slow = df.where((F.year("ts") == 2023) & (F.month("ts") <= 5)).count()
    assert fast == slow == 2
    assert df.where(months.in_months_of_year("ts", 2022, 12, 12)).count() == 1


def test_day_in_zone(spark):
    row = spark.range(1).select(
        months.day_in_zone(moment("2023-05-02 02:59:00"), "America/Sao_Paulo").alias("before"),
        months.day_in_zone(moment("2023-05-02 03:00:00"), "America/Sao_Paulo").alias("after"),
    ).first()
    assert (row.before, row.after) == (date(2023, 5, 1), date(2023, 5, 2))
