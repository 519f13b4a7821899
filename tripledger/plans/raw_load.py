"""Landing files to the raw table, one month replaced per file."""

from __future__ import annotations

import logging
from dataclasses import dataclass, replace
from datetime import date, datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripledger import names as n
from tripledger.functions.columns import moment
from tripledger.functions.months import day_in_zone, months_between
from tripledger.operators.conform import EmptyInputError, conform, require_rows
from tripledger.operators.publish import publish, write_run
from tripledger.operators.rules import TYPE_FLAGS
from tripledger.operators.writers import arrange, replace_partitions
from tripledger.session import setting
from tripledger.sources import contracts, ledger
from tripledger.sources.landing import scan_month, scan_months, with_load_metadata
from tripledger.sources.tables import create_raw

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class RawLoad:
    """``failures="stop"`` writes all months in one job, or none of them;
    ``"continue"`` writes month by month and reports the months that failed.
    ``cluster=False`` leaves the rows in the order and file sizes they were read in, which
    spares shuffling them. ``publish="commit"`` replaces the months' files when the job commits; ``"pointer"`` writes them
    beside the old ones and then has the catalog point to them, so that readers of the table find either whatever breaks.
    ``on_error="flag"`` records a delivered value that does not fit, so that the
    type rules judge it later; ``"null"`` drops it silently, ``"raise"`` stops the load."""

    landing: str
    table: str
    start: str
    end: str
    as_of: str | None = None
    template: str = n.LANDING_TEMPLATE
    zone: str = n.LANDING_ZONE
    extras: str = "drop"
    on_error: str = "flag"
    failures: str = "stop"
    cluster: bool = True
    publish: str = "commit"


#: Raw column -> the flag that says its delivered value did not fit.
RAW_FLAGS = {**{c: flag for c, flag in TYPE_FLAGS.items() if c != n.VENDOR}, "VendorID": TYPE_FLAGS[n.VENDOR]}


def conform_raw(rows: DataFrame, extras: str = "drop", on_error: str = "flag") -> DataFrame:
    """The raw table's columns: the declared 21 and the type flags."""
    conformed = conform(rows, contracts.raw_schema(), extras, on_error, RAW_FLAGS)
    missing = [flag for flag in TYPE_FLAGS.values() if flag not in conformed.columns]
    return conformed.withColumns({flag: F.lit(0) for flag in missing})


def conformed_month(spark: SparkSession, job: RawLoad, year: int, month: int) -> DataFrame:
    landed = scan_month(spark, job.landing, year, month, job.template)
    dated = with_load_metadata(landed, year, month, job.as_of, job.zone, cast=False)
    return conform_raw(dated, job.extras, job.on_error)


def conformed_months(spark: SparkSession, job: RawLoad, months: list[tuple[int, int]]) -> DataFrame:
    """The rows of all months from as few scans as the types in their files allow, each conformed alone."""
    dated = [
        with_load_metadata(rows, None, None, job.as_of, job.zone, cast=False)
        for rows in scan_months(spark, job.landing, months, job.template)
    ]
    return reduce(DataFrame.unionByName, [conform_raw(rows, job.extras, job.on_error) for rows in dated])


def _replace(spark: SparkSession, rows: DataFrame, job: RawLoad, months: list[tuple[int, int]]) -> None:
    entries = [f"{year}-{month:02d}-01" for year, month in months]
    day = spark.range(1).select(day_in_zone(moment(job.as_of), job.zone)).first()[0]
    ledger.strike_out(spark, job.table, entries)
    rows = arrange(rows, (n.MONTH,), ("VendorID",)) if job.cluster else rows
    if job.publish == "pointer":
        publish([write_run(rows, job.table)])
    else:
        replace_partitions(rows, job.table)
    ledger.enter(spark, job.table, entries, day)


def load_raw(spark: SparkSession, job: RawLoad) -> dict[str, str]:
    """Run the load; the result maps each failed month to its error."""
    if job.failures not in ("stop", "continue"):
        raise ValueError("failures must be 'stop' or 'continue'")
    if job.publish not in ("commit", "pointer"):
        raise ValueError("publish must be 'commit' or 'pointer'")
    now = job.as_of or datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M:%S")
    job = replace(job, as_of=now)  # one moment, read as UTC whatever the session's zone
    months = months_between(job.start, job.end, date.fromisoformat(now[:10]))
    with setting(spark, "spark.sql.session.timeZone", "UTC"):
        create_raw(spark, job.table)
        if job.failures == "stop":
            rows = conformed_months(spark, job, months)
            _require_all(rows, months)
            _replace(spark, rows, job, months)
            return {}
        failed = {}
        for year, month in months:
            try:
                rows = require_rows(conformed_month(spark, job, year, month), f"month {year}-{month:02d}")
                _replace(spark, rows, job, [(year, month)])
            except Exception as error:  # each month stands alone here
                log.error("month %d-%02d failed: %s", year, month, error)
                failed[f"{year}-{month:02d}"] = str(error)
        return failed


def _require_all(rows: DataFrame, months: list[tuple[int, int]]) -> None:
    """Every month holds a row: one job, which reads no column of the files."""
    found = {str(r[0])[:7] for r in rows.select(n.MONTH).distinct().collect()}
    for year, month in months:
        if f"{year}-{month:02d}" not in found:
            raise EmptyInputError(f"month {year}-{month:02d} holds no rows")
