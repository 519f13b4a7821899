"""From raw columns to the core columns the rules look at."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tripledger import names as n
from tripledger.functions.columns import as_flag
from tripledger.functions.months import in_month_range
from tripledger.operators.rules import CORE_TYPES, TYPE_FLAGS


def latest_load(raw: DataFrame, newest: date | None = None) -> Column:
    """Rows of the newest load day. The day is taken over the whole table, not the
    selected months, so months loaded on an earlier day drop out. ``newest`` is that day where
    it is known, see ``sources.ledger``; else the table is asked for it."""
    return F.col(n.LOADED) == (F.lit(newest) if newest else raw.agg(F.max(n.LOADED)).scalar())


def with_pickup_month(rows: DataFrame) -> DataFrame:
    return rows.withColumn(n.PICKUP_MONTH, F.trunc(n.PICKUP, "month"))


def project_core(
    raw: DataFrame, on_error: str = "raise", sources: dict[str, str] | None = None, once: bool = False
) -> DataFrame:
    """Core columns under their trusted names and types, then the two load dates.

    ``on_error`` says what a value that does not fit does: ``"raise"`` stops the query,
    ``"null"`` yields NULL, ``"flag"`` yields NULL and records it in the type flags, so
    that the type rules judge the value as it was delivered.

    ``once`` casts every value once, as generated columns, for text that many conditions look at: a filter
    on the verdict would else parse it anew wherever a rule names it. Columns nobody reads are then cast too.
    """
    if on_error not in ("raise", "null", "flag"):
        raise ValueError("on_error must be 'raise', 'null' or 'flag'")
    sources = {n.VENDOR: "VendorID", **(sources or {})}
    is_text = {f.name: isinstance(f.dataType, StringType) for f in raw.schema}
    there, typed = {}, {}
    for name, kind in CORE_TYPES.items():
        given = F.col(sources.get(name, name))
        # Counts may arrive as text with decimals: read them as numbers, then truncate.
        wide = given.try_cast("double") if name == n.PASSENGERS and is_text[sources.get(name, name)] else given
        typed[name] = wide.cast(kind) if on_error == "raise" else wide.try_cast(kind)
        there[name] = given.isNotNull()
    if once:
        kept = [c for c in (n.MONTH, n.LOADED, *TYPE_FLAGS.values()) if c in raw.columns]
        told = [typed[c].alias(c) for c in CORE_TYPES] + [there[c].alias(f"{c} given") for c in CORE_TYPES]
        raw = raw.select(*kept, F.inline(F.array(F.struct(*told))))
        typed, there = {c: F.col(c) for c in CORE_TYPES}, {c: F.col(f"{c} given") for c in CORE_TYPES}
    columns, flags = [], []
    for name in CORE_TYPES:
        columns.append(typed[name].alias(name))
        lost = there[name] & typed[name].isNull()
        if TYPE_FLAGS[name] in raw.columns:  # lost already when the raw table was filled
            lost = lost | (F.col(TYPE_FLAGS[name]) == 1)
        flags.append(as_flag(lost).alias(TYPE_FLAGS[name]))
    dates = [F.col(c).cast("date").alias(c) for c in (n.MONTH, n.LOADED) if c in raw.columns]
    return raw.select(columns + dates + (flags if on_error == "flag" else []))


def stage(
    raw: DataFrame, start: str, end: str, on_error: str = "raise", today: date | None = None,
    newest: date | None = None,
) -> DataFrame:
    """Newest load of an inclusive month range, as core columns."""
    picked = raw.where(in_month_range(n.MONTH, start, end, today)).where(latest_load(raw, newest))
    return project_core(picked, on_error)
