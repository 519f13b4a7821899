"""Small column builders shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_flag(condition: Column) -> Column:
    """1 where the condition holds, else 0; an unknown condition counts as 0."""
    return F.when(condition, F.lit(1)).otherwise(F.lit(0))


def whole_seconds(start: Column, end: Column) -> Column:
    """Difference of two instants after flooring each to the second."""
    return end.cast("bigint") - start.cast("bigint")


def percent(part: Column, whole: Column) -> Column:
    """Share in percent as DECIMAL, rounded half up to two places; NULL where whole is 0."""
    ratio = F.lit("100.0").cast("decimal(4,1)") * part / F.nullif(whole, F.lit(0))
    return F.round(ratio, 2)


def moment(text: str) -> Column:
    """A timestamp literal in the session zone."""
    return F.lit(text).cast("timestamp")
