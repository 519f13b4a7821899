"""Quality metrics in one aggregate, and the reports read from that one row."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripledger import names as n
from tripledger.functions.columns import percent
from tripledger.operators.rules import LOGIC, NULL, RANGE, TYPE, Rule, rules_of


def quality_metrics(flagged: DataFrame, pack: str = "coded") -> DataFrame:
    """One row: totals, rows per rule and percentages. Sums combine before the shuffle."""
    pack_rules = rules_of(pack)
    totals = flagged.agg(
        F.count("*").alias(n.TOTAL_ROWS),
        F.sum(n.VERDICT).alias(n.TOTAL_ERRORS),
        *[F.sum(r.flag).alias(r.metric) for r in pack_rules],
    )
    rows, errors = F.col(n.TOTAL_ROWS), F.col(n.TOTAL_ERRORS)
    type_errors = reduce(add, [F.col(r.metric) for r in pack_rules if r.report == TYPE])
    return totals.select(
        n.TOTAL_ROWS,
        n.TOTAL_ERRORS,
        (rows - errors).alias(n.TOTAL_VALID),
        *[r.metric for r in pack_rules],
        percent(errors, rows).alias(n.PCT_ERROR),
        percent(rows - errors, rows).alias(n.PCT_VALID),
        percent(type_errors, rows).alias(n.PCT_TYPE),
    )


def _with_sign(column: str):
    return F.concat(F.col(column).cast("string"), F.lit("%"))


def _section(metrics: DataFrame, pack: str, report: str, *more) -> DataFrame:
    chosen = [F.col(r.metric).alias(r.report_name) for r in rules_of(pack) if r.report == report]
    return metrics.select(*chosen, *more)


# --- fixed values: report column names -------------------------------------------
def report_summary(metrics: DataFrame) -> DataFrame:
    return metrics.select(
        F.col(n.TOTAL_ROWS).alias("total_processado"),
        F.col(n.TOTAL_VALID).alias("aprovados"),
        F.col(n.TOTAL_ERRORS).alias("reprovados"),
        _with_sign(n.PCT_VALID).alias("taxa_aprovacao"),
        _with_sign(n.PCT_ERROR).alias("taxa_erro"),
    )


def report_types(metrics: DataFrame, pack: str = "coded") -> DataFrame:
    return _section(metrics, pack, TYPE, _with_sign(n.PCT_TYPE).alias("percentual_erro_tipo"))


def report_nulls(metrics: DataFrame, pack: str = "coded") -> DataFrame:
    return _section(metrics, pack, NULL)


def report_ranges(metrics: DataFrame, pack: str = "coded") -> DataFrame:
    return _section(metrics, pack, RANGE)


def report_logic(metrics: DataFrame, pack: str = "coded") -> DataFrame:
    return _section(metrics, pack, LOGIC)


def report_long(metrics: DataFrame, pack: str = "coded") -> DataFrame:
    """All rule counts as (section, rule, rows), one line per rule."""

    def line(r: Rule):
        return F.struct(
            F.lit(r.report).alias("section"), F.lit(r.report_name).alias("rule"), F.col(r.metric).alias("rows")
        )

    return metrics.select(F.inline(F.array(*[line(r) for r in rules_of(pack)])))


def run_summary(quarantine: DataFrame, day) -> DataFrame:
    """Rows quarantined on a day: all, of the type class and of the logic class, in one pass."""
    kind = F.col(n.ERROR_CLASS)
    return quarantine.where(F.col(n.QUARANTINE_DAY) == day).agg(
        F.count("*").alias("registros_quarentena"),
        F.count_if(kind == n.CLASS_TYPE).alias("erros_tipagem"),
        F.count_if(kind == n.CLASS_LOGIC).alias("erros_logica_negocio"),
    )


def quarantine_by_class(quarantine: DataFrame) -> DataFrame:
    return quarantine.groupBy(n.QUARANTINE_DAY, n.ERROR_CLASS).agg(F.count("*").alias("rows"))


def reason_patterns(quarantine: DataFrame) -> DataFrame:
    """How often each combination of reasons occurs."""
    return quarantine.groupBy(n.ERROR_CLASS, n.REASONS).agg(F.count("*").alias("rows"))
