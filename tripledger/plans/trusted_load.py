"""Raw table to trusted and quarantine tables, behind the quality gates."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession

from tripledger import names as n
from tripledger.operators.gates import enforce, gate_error_rate, gate_type_rate
from tripledger.operators.merge import insert_only_merge
from tripledger.operators.metrics import quality_metrics, run_summary
from tripledger.operators.publish import Run, publish, write_run
from tripledger.operators.rules import Limits, quarantine_rows, valid_rows, with_rules
from tripledger.operators.staging import stage, with_pickup_month
from tripledger.operators.writers import append, arrange, truncate
from tripledger.session import setting
from tripledger.sources.ledger import newest_load
from tripledger.sources.tables import create_quarantine, create_staging, create_trusted, partition_values

STAGING_KEYS = [n.VENDOR, n.PICKUP, n.DROPOFF]


@dataclass(frozen=True)
class TrustedLoad:
    """Tables, month range and rules of one run.

    Every check compares with the one moment in ``limits``, so metrics, gates and both
    writes judge a row alike however often Spark evaluates it. ``publish="pointer"`` creates the trusted and quarantine tables
    with partitions per load and shows both results at the end, each as a whole (``operators.publish``); ``buckets`` creates
    the trusted table with that many per month, so that its keys are not shuffled.
    """

    raw: str
    staging: str
    trusted: str
    quarantine: str
    start: str
    end: str
    limits: Limits
    pack: str = "coded"
    dedupe_source: bool = False
    null_safe: bool = False
    max_pct_error: str = n.MAX_PCT_ERROR
    max_pct_type: str = n.MAX_PCT_TYPE
    publish: str = "commit"
    buckets: int = 0


@dataclass(frozen=True)
class RunResult:
    metrics: DataFrame
    gates: DataFrame
    summary: DataFrame


def stage_batch(spark: SparkSession, job: TrustedLoad) -> DataFrame:
    """Add the batch to the staging table. Rows a failed run left there are judged again."""
    newest = newest_load(spark, job.raw, n.MONTH)
    batch = stage(spark.table(job.raw), job.start, job.end, "flag", _day(job.limits), newest)
    insert_only_merge(
        with_pickup_month(batch), job.staging, STAGING_KEYS, job.null_safe, job.dedupe_source,
        prune_on=n.PICKUP_MONTH, layout=((n.PICKUP_MONTH,), ()),
    )
    return spark.table(job.staging)


def _day(limits: Limits) -> date:
    return date.fromisoformat(limits.as_of[:10])


def write_trusted(flagged: DataFrame, job: TrustedLoad, brought: set[str | None] | None = None) -> Run | None:
    """Valid rows of the flagged ones; gives the run, if it is to be published. ``brought``: their pickup months, where the caller knows them;
    the months the table lacks are then read apart from those that are joined."""
    valid = valid_rows(flagged, n.PICKUP_MONTH) if n.PICKUP_MONTH in flagged.columns else with_pickup_month(valid_rows(flagged))
    return insert_only_merge(
        valid, job.trusted, n.CORE, prune_on=n.PICKUP_MONTH,
        layout=((n.PICKUP_MONTH,), (n.VENDOR, n.PICKUP)), brought=brought, write=_writer(job),
    )


def _writer(job: TrustedLoad):
    return write_run if job.publish == "pointer" else append


def write_quarantine(rejected: DataFrame, job: TrustedLoad) -> Run | None:
    """The coded key holds the moment of the run, which no stored row can match: the merge
    is an append. The documented key leaves it out, so a repeated run adds nothing."""
    layout = ((n.QUARANTINE_DAY, n.ERROR_CLASS), (n.VENDOR,))
    if job.pack == "coded":
        return _writer(job)(arrange(rejected, *layout), job.quarantine)
    keys = [c for c in rejected.columns if c != n.STAMP]
    return insert_only_merge(
        rejected, job.quarantine, keys, null_safe=True, prune_on=n.QUARANTINE_DAY,
        layout=layout, brought={_day(job.limits).isoformat()}, write=_writer(job),
    )


def load_trusted(spark: SparkSession, job: TrustedLoad) -> RunResult:
    """Stage, check, gate, write valid and rejected rows, summarise, empty the staging table.

    The staging table is read for the metrics, the valid rows (and before, for rows of very many copies) and the rejected rows. The trusted
    table's keys are read once, in the months the batch has too. All moments are UTC, whatever the
    session's zone. A failed gate raises before either write and leaves the staging table as it is.
    The flagged rows and their metrics can be queried by SQL as temporary views; the view
    of the rows is empty again once the staging table is.
    """
    if job.publish not in ("commit", "pointer"):
        raise ValueError("publish must be 'commit' or 'pointer'")
    with setting(spark, "spark.sql.session.timeZone", "UTC"):
        return _load(spark, job)


def _load(spark: SparkSession, job: TrustedLoad) -> RunResult:
    create_staging(spark, job.staging)
    by_run = job.publish == "pointer"
    create_trusted(spark, job.trusted, buckets=job.buckets, by_run=by_run)
    create_quarantine(spark, job.quarantine, job.pack, by_run=by_run)

    # The staging table is the one stored intermediate. Flags are cheap to compute from it,
    # so they are not kept in executor memory, where losing one would cost a recomputation.
    staged = stage_batch(spark, job)
    months = partition_values(spark, job.staging, n.PICKUP_MONTH)
    flagged = with_rules(staged, job.limits, job.pack)
    measured = quality_metrics(flagged, job.pack)
    metrics = spark.createDataFrame(measured.collect(), measured.schema)
    flagged.createOrReplaceTempView(n.FLAGGED_VIEW)
    metrics.createOrReplaceTempView(n.METRICS_VIEW)
    gates = gate_error_rate(metrics, job.max_pct_error).unionByName(gate_type_rate(metrics, job.max_pct_type))
    enforce(gates)

    runs = [write_trusted(flagged, job, months)]
    rejected = quarantine_rows(flagged.drop(n.PICKUP_MONTH), job.limits, job.pack)
    runs.append(write_quarantine(rejected, job))
    if by_run:
        publish(runs)  # both are written by now

    counted = run_summary(spark.table(job.quarantine), job.limits.today)
    summary = spark.createDataFrame(counted.collect(), counted.schema)
    truncate(spark, job.staging)
    return RunResult(metrics, gates, summary)
