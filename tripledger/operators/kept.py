"""Rollups from kept partial aggregates.

A small table holds, for every pickup month, hour of day and vendor, the sums, counts, minima and maxima from which the calendar
questions and profiles follow. It is partitioned by pickup month, and each row carries a mark of the trusted files its month was
computed from. ``refresh`` compares marks and reads only the months whose files have changed, so a question asked after
a new month costs that month, whatever the table holds.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tripledger import names as n
from tripledger.operators.rollups import positive
from tripledger.operators.writers import arrange, replace_partitions
from tripledger.sources.tables import create_table

#: Mark of the files a row was computed from.
MARK = "files_mark"

COLUMNS = (
    f"ano int, mes int, hora int, {n.VENDOR} int, total bigint, first_pickup timestamp, last_pickup timestamp, "
    "amounts bigint, amount_sum double, amount_min double, amount_max double, "
    "seated bigint, seats_sum bigint, seats_min int, seats_max int, "
    f"clean bigint, clean_amount double, clean_seats bigint, {MARK} string, {n.PICKUP_MONTH} date"
)


def create_kept(spark: SparkSession, name: str, location: str | None = None) -> None:
    create_table(spark, name, StructType.fromDDL(COLUMNS), (n.PICKUP_MONTH,), "partial aggregates of checked trips", location)


def partials(trips: DataFrame) -> DataFrame:
    """One row per pickup month, hour and vendor; combined before the shuffle, so its size is that of the groups."""
    amount, seats = F.col(n.AMOUNT), F.col(n.PASSENGERS)
    paid, taken = positive(n.AMOUNT), positive(n.PASSENGERS)
    both = paid & taken
    keys = [F.col(n.PICKUP_MONTH), F.year(n.PICKUP).alias("ano"), F.month(n.PICKUP).alias("mes"), F.hour(n.PICKUP).alias("hora"), F.col(n.VENDOR)]
    return trips.groupBy(*keys).agg(
        F.count("*").alias("total"), F.min(n.PICKUP).alias("first_pickup"), F.max(n.PICKUP).alias("last_pickup"),
        F.count_if(paid).alias("amounts"), F.sum(F.when(paid, amount)).alias("amount_sum"),
        F.min(F.when(paid, amount)).alias("amount_min"), F.max(F.when(paid, amount)).alias("amount_max"),
        F.count_if(taken).alias("seated"), F.sum(F.when(taken, seats)).alias("seats_sum"),
        F.min(F.when(taken, seats)).alias("seats_min"), F.max(F.when(taken, seats)).alias("seats_max"),
        F.count_if(both).alias("clean"), F.sum(F.when(both, amount)).alias("clean_amount"),
        F.sum(F.when(both, seats)).alias("clean_seats"),
    )


def file_marks(trips: DataFrame) -> DataFrame:
    """Per pickup month a mark that changes when files of the month come, go or change. No column of a file is read: the rows
    are counted by the files' own footers."""
    meta = trips.metadataColumn("_metadata")
    about = {"path": meta["file_path"], "size": meta["file_size"], "at": meta["file_modification_time"]}
    files = trips.select(n.PICKUP_MONTH, *[c.alias(name) for name, c in about.items()])
    files = files.groupBy(n.PICKUP_MONTH, *about).agg(F.count("*").alias("held"))
    digest = F.bit_xor(F.xxhash64(*about, "held"))
    mark = F.concat_ws(":", F.count("*"), F.sum("held"), digest)
    return files.groupBy(n.PICKUP_MONTH).agg(mark.alias(MARK))


def _among(months: list[date | None]) -> Column:
    """The months as literals, so that partitions prune."""
    known = [m for m in months if m is not None]
    found = F.col(n.PICKUP_MONTH).isin(known) if known else F.lit(False)
    return found | F.col(n.PICKUP_MONTH).isNull() if None in months else found


def refresh(spark: SparkSession, trusted: str, kept: str) -> list[date | None]:
    """Brings the kept aggregates up to date with the trusted table and gives the months computed anew.

    Marks are taken before the rows are read: what is written to the table meanwhile is found by the next refresh. A
    month is replaced with its mark, so a refresh that breaks is made good by the next. The driver receives a mark per month.
    """
    trips = spark.table(trusted)
    now = {r[0]: r[1] for r in file_marks(trips).collect()}
    then = {r[0]: r[1] for r in spark.table(kept).select(n.PICKUP_MONTH, MARK).distinct().collect()}
    for month in then.keys() - now.keys():
        value = "NULL" if month is None else f"DATE'{month}'"
        spark.sql(f"ALTER TABLE IDENTIFIER(:name) DROP IF EXISTS PARTITION (`{n.PICKUP_MONTH}` = {value})", {"name": kept})
    touched = [month for month, mark in now.items() if then.get(month) != mark]
    if touched:
        marks = spark.createDataFrame([(m, now[m]) for m in touched], f"marked date, {MARK} string")
        rows = partials(trips.where(_among(touched)))
        rows = rows.join(F.broadcast(marks), F.col(n.PICKUP_MONTH).eqNullSafe(F.col("marked")))  # a row per month
        replace_partitions(arrange(rows, (n.PICKUP_MONTH,)), kept)
    return sorted(touched, key=str)


def _of_months(kept: DataFrame, year: int, first: int, last: int) -> DataFrame:
    return kept.where(F.col(n.PICKUP_MONTH).between(F.lit(date(year, first, 1)), F.lit(date(year, last, 1))))


def monthly_amount(kept: DataFrame, year: int | None = None, months: tuple[int, int] = (1, 12)) -> DataFrame:
    """``rollups.monthly_amount`` from the kept aggregates."""
    rows = kept if year is None else _of_months(kept, year, *months)
    grouped = rows.where("amounts > 0").groupBy("ano", "mes").agg(
        F.round(F.sum("amount_sum") / F.sum("amounts"), 2).alias("media_valor_total"),
        F.sum("amounts").alias("total_corridas"),
        F.round(F.sum("amount_sum"), 2).alias("valor_total_periodo"),
        F.round(F.min("amount_min"), 2).alias("valor_minimo"),
        F.round(F.max("amount_max"), 2).alias("valor_maximo"),
    )
    label = F.concat(F.col("ano"), F.lit("-"), F.lpad(F.col("mes").cast("string"), 2, "0")).alias("periodo")
    return grouped.select("ano", "mes", label, *grouped.columns[2:]).orderBy("ano", "mes")


def hourly_passengers(kept: DataFrame, year: int, month: int) -> DataFrame:
    """``rollups.hourly_passengers`` from the kept aggregates."""
    rows = _of_months(kept, year, month, month).where("seated > 0")
    grouped = rows.groupBy(F.col("hora").alias("hora_do_dia")).agg(
        F.round(F.sum("seats_sum") / F.sum("seated"), 2).alias("media_passageiros"),
        F.sum("seated").alias("total_corridas"),
        F.sum("seats_sum").alias("total_passageiros"),
        F.min("seats_min").alias("min_passageiros"),
        F.max("seats_max").alias("max_passageiros"),
    )
    return grouped.orderBy("hora_do_dia")


def trusted_profile(kept: DataFrame) -> DataFrame:
    """``rollups.trusted_profile`` from the kept aggregates."""
    return kept.agg(
        F.coalesce(F.sum("total"), F.lit(0)).alias("total_registros"),
        F.count_distinct(n.VENDOR).alias("vendors_unicos"),
        F.min("first_pickup").alias("primeira_corrida"),
        F.max("last_pickup").alias("ultima_corrida"),
    )


def clean_profile(kept: DataFrame) -> DataFrame:
    """``rollups.clean_profile`` from the kept aggregates."""
    rows = F.sum("clean")
    return kept.where("clean > 0").agg(
        F.coalesce(rows, F.lit(0)).alias("total_registros"),
        F.count_distinct(n.VENDOR).alias("vendors_unicos"),
        F.round(F.sum("clean_amount") / rows, 2).alias("media_valor"),
        F.round(F.sum("clean_seats") / rows, 2).alias("media_passageiros"),
    )
