"""Threshold gates over the metrics row."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripledger import names as n


class GateError(RuntimeError):
    """A quality threshold was exceeded, or nothing was there to measure."""


def _gate(metrics: DataFrame, name: str, percent: str, rows: str, threshold: str) -> DataFrame:
    # The rounded percentage is compared, with the limit just as it was given; a NULL percentage
    # (no rows) does not pass.
    limit = F.lit(Decimal(threshold))
    return metrics.select(
        F.lit(name).alias("gate"),
        F.col(rows).alias("rows_in_error") if rows else F.lit(None).cast("bigint").alias("rows_in_error"),
        F.col(percent).alias("observed"),
        limit.alias("threshold"),
        F.coalesce(F.col(percent) <= limit, F.lit(False)).alias("passed"),
    )


def gate_error_rate(metrics: DataFrame, threshold: str = n.MAX_PCT_ERROR) -> DataFrame:
    return _gate(metrics, "error_rate", n.PCT_ERROR, n.TOTAL_ERRORS, threshold)


def gate_type_rate(metrics: DataFrame, threshold: str = n.MAX_PCT_TYPE) -> DataFrame:
    return _gate(metrics, "type_rate", n.PCT_TYPE, "", threshold)


def non_empty_gate(spine: DataFrame, rows: DataFrame, column: str) -> DataFrame:
    """One line per month of the spine: how many rows it has, and whether it has any.

    Rows are counted per month before the join, which then meets a few lines per year.
    """
    counted = rows.groupBy(F.trunc(column, "month").alias("month")).agg(F.count("*").alias("found"))
    found = F.coalesce("found", F.lit(0).cast("bigint"))
    return spine.join(counted, "month", "left").select("month", found.alias("rows"), (found > 0).alias("passed"))


def enforce(gates: DataFrame) -> None:
    """Raise on the first gate that did not pass; gates hold one row each."""
    for gate in gates.collect():
        if not gate["passed"]:
            if gate["observed"] is None:
                raise GateError(f"{gate['gate']}: nothing was measured, the batch holds no rows")
            affected = "" if gate["rows_in_error"] is None else f", {gate['rows_in_error']} rows in error"
            raise GateError(f"{gate['gate']}: {gate['observed']}% exceeds {gate['threshold']}%{affected}")
