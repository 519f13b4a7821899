"""Month parameters, month spines and calendar ranges."""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripledger.names import MONTH_PATTERN


def parse_month(text: str) -> date:
    """First day of a ``YYYY-MM`` month."""
    if not isinstance(text, str) or not re.fullmatch(MONTH_PATTERN.strip("^$"), text):
        raise ValueError(f"month {text!r} is not of the form YYYY-MM")
    year, month = text.split("-")
    return date(int(year), int(month), 1)


def month_bounds(start: str, end: str, today: date | None = None) -> tuple[date, date]:
    """Checked first days of the first and last month of an inclusive range."""
    first, last = parse_month(start), parse_month(end)
    if first > last:
        raise ValueError(f"start month {start} lies after end month {end}")
    if last > (today or date.today()):
        raise ValueError(f"month range {start}..{end} reaches into the future")
    return first, last


def next_month(day: date) -> date:
    return date(day.year + day.month // 12, day.month % 12 + 1, 1)


def months_between(start: str, end: str, today: date | None = None) -> list[tuple[int, int]]:
    """Every (year, month) of an inclusive range."""
    first, last = month_bounds(start, end, today)
    count = (last.year - first.year) * 12 + last.month - first.month + 1
    offsets = range(first.month - 1, first.month - 1 + count)
    return [(first.year + m // 12, m % 12 + 1) for m in offsets]


def month_spine(spark: SparkSession, start: str, end: str, today: date | None = None) -> DataFrame:
    """One row per month of the range: ``month`` (first day), ``year``, ``month_number``."""
    first, last = month_bounds(start, end, today)
    bounds = spark.range(1).select(F.lit(first).alias("lo"), F.lit(last).alias("hi"))
    return expand_months(bounds, "lo", "hi")


def observed_spine(df: DataFrame, column: str) -> DataFrame:
    """The spine from the first to the last month found in a date column."""
    month = F.trunc(column, "month")
    return expand_months(df.agg(F.min(month).alias("lo"), F.max(month).alias("hi")), "lo", "hi")


def expand_months(bounds: DataFrame, lo: str, hi: str) -> DataFrame:
    month = F.explode(F.sequence(F.col(lo), F.col(hi), F.expr("interval 1 month")))
    return bounds.select(month.alias("month")).select(
        "month", F.year("month").alias("year"), F.month("month").alias("month_number")
    )


def is_month_text(column: str | Column) -> Column:
    """Row form of the month parameter check."""
    text = F.col(column) if isinstance(column, str) else column
    return text.rlike(MONTH_PATTERN)


def in_month_range(column: str, start: str, end: str, today: date | None = None) -> Column:
    """Month column within an inclusive range, as date literals so that partitions prune."""
    first, last = month_bounds(start, end, today)
    return F.col(column).between(F.lit(first), F.lit(last))


def in_calendar_range(column: str, first: date, until: date) -> Column:
    """``first <= column < until``: unlike ``year(column) = y`` this reaches the file scan."""
    # Text literals take the session zone; Python datetimes would take the driver's.
    lo = F.lit(f"{first.isoformat()} 00:00:00").cast("timestamp")
    hi = F.lit(f"{until.isoformat()} 00:00:00").cast("timestamp")
    return (F.col(column) >= lo) & (F.col(column) < hi)


def in_months_of_year(column: str, year: int, first: int, last: int) -> Column:
    return in_calendar_range(column, date(year, first, 1), next_month(date(year, last, 1)))


def month_label(column: str) -> Column:
    """``YYYY-MM`` with the month padded to two digits."""
    return F.concat(F.year(column), F.lit("-"), F.lpad(F.month(column).cast("string"), 2, "0"))


def day_in_zone(moment: Column, zone: str) -> Column:
    """Calendar day of an instant in a named zone (session zone UTC)."""
    return F.to_date(F.from_utc_timestamp(moment, zone))
