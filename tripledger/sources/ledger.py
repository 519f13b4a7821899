"""When each month of a raw table was loaded, kept with the table's properties.

A month is always replaced as a whole, so the newest of the kept days is the newest load day of the
table, and no file has to be read for it. A load strikes its months out before it writes and
enters them after; while an entry is missing, the answer is None and the table itself is asked.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import SparkSession

from tripledger.sources.tables import partition_values

PREFIX = "tripledger.loaded."


def _entries(spark: SparkSession, table: str) -> dict[str, str]:
    rows = spark.sql("SHOW TBLPROPERTIES IDENTIFIER(:name)", {"name": table}).collect()
    return {r["key"].removeprefix(PREFIX): r["value"] for r in rows if r["key"].startswith(PREFIX)}


def strike_out(spark: SparkSession, table: str, months: list[str]) -> None:
    keys = ", ".join(f"'{PREFIX}{m}'" for m in months)
    spark.sql(f"ALTER TABLE IDENTIFIER(:name) UNSET TBLPROPERTIES IF EXISTS ({keys})", {"name": table})


def enter(spark: SparkSession, table: str, months: list[str], day: date) -> None:
    pairs = ", ".join(f"'{PREFIX}{m}' = '{day.isoformat()}'" for m in months)
    spark.sql(f"ALTER TABLE IDENTIFIER(:name) SET TBLPROPERTIES ({pairs})", {"name": table})


def newest_load(spark: SparkSession, table: str, month_column: str) -> date | None:
    """The newest load day, or None unless every stored month is entered."""
    stored = partition_values(spark, table, month_column)
    entries = _entries(spark, table)
    if not stored or None in stored or not stored <= set(entries):
        return None
    return date.fromisoformat(max(entries[m] for m in stored))
