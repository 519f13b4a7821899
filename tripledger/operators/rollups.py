"""Calendar rollups and profiles. Groups are few, so all aggregation combines map-side."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripledger import names as n
from tripledger.functions.columns import whole_seconds
from tripledger.functions.months import in_months_of_year, month_label


def positive(column: str) -> Column:
    return F.col(column).isNotNull() & (F.col(column) > 0)


def _rounded(aggregate, column: str, digits: int) -> Column:
    return F.round(aggregate(column), digits)


def _in_months(trips: DataFrame, year: int, first: int, last: int) -> DataFrame:
    """Pickup within the months; a table laid out by pickup month also skips partitions."""
    kept = trips.where(in_months_of_year(n.PICKUP, year, first, last))
    if n.PICKUP_MONTH in trips.columns:
        months = F.col(n.PICKUP_MONTH).between(F.lit(date(year, first, 1)), F.lit(date(year, last, 1)))
        kept = kept.where(months)
    return kept


# --- fixed values: result column names -------------------------------------------
def monthly_amount(
    trips: DataFrame,
    year: int | None = None,
    months: tuple[int, int] = (1, 12),
    columns: list[str] | None = None,
) -> DataFrame:
    """Charged amounts per pickup month, positive amounts only, in calendar order.

    Without a year all months count; ``columns`` picks some of the result columns.
    """
    kept = trips if year is None else _in_months(trips, year, *months)
    grouped = (
        kept.where(positive(n.AMOUNT))
        .groupBy(F.year(n.PICKUP).alias("ano"), F.month(n.PICKUP).alias("mes"))
        .agg(
            _rounded(F.avg, n.AMOUNT, 2).alias("media_valor_total"),
            F.count("*").alias("total_corridas"),
            _rounded(F.sum, n.AMOUNT, 2).alias("valor_total_periodo"),
            _rounded(F.min, n.AMOUNT, 2).alias("valor_minimo"),
            _rounded(F.max, n.AMOUNT, 2).alias("valor_maximo"),
        )
    )
    label = F.concat(F.col("ano"), F.lit("-"), F.lpad(F.col("mes").cast("string"), 2, "0"))
    result = grouped.select(
        "ano", "mes", label.alias("periodo"), "media_valor_total", "total_corridas",
        "valor_total_periodo", "valor_minimo", "valor_maximo",
    )
    return result.select(*(columns or result.columns)).orderBy("ano", "mes")


def hourly_passengers(
    trips: DataFrame, year: int, month: int, columns: list[str] | None = None
) -> DataFrame:
    """Passengers per pickup hour of one month, positive counts only, in order of the hour."""
    grouped = (
        _in_months(trips, year, month, month)
        .where(positive(n.PASSENGERS))
        .groupBy(F.hour(n.PICKUP).alias("hora_do_dia"))
        .agg(
            _rounded(F.avg, n.PASSENGERS, 2).alias("media_passageiros"),
            F.count("*").alias("total_corridas"),
            _rounded(F.sum, n.PASSENGERS, 0).alias("total_passageiros"),
            _rounded(F.min, n.PASSENGERS, 0).alias("min_passageiros"),
            _rounded(F.max, n.PASSENGERS, 0).alias("max_passageiros"),
        )
    )
    return grouped.select(*(columns or grouped.columns)).orderBy("hora_do_dia")


def row_count(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("total_registros"))


def trusted_profile(trips: DataFrame) -> DataFrame:
    return trips.agg(
        F.count("*").alias("total_registros"),
        F.count_distinct(n.VENDOR).alias("vendors_unicos"),
        F.min(n.PICKUP).alias("primeira_corrida"),
        F.max(n.PICKUP).alias("ultima_corrida"),
    )


def clean_profile(trips: DataFrame) -> DataFrame:
    return trips.where((F.col(n.AMOUNT) > 0) & (F.col(n.PASSENGERS) > 0)).agg(
        F.count("*").alias("total_registros"),
        F.count_distinct(n.VENDOR).alias("vendors_unicos"),
        _rounded(F.avg, n.AMOUNT, 2).alias("media_valor"),
        _rounded(F.avg, n.PASSENGERS, 2).alias("media_passageiros"),
    )


def coverage_profile(raw: DataFrame) -> DataFrame:
    """Total rows and covered period as (metric, value) lines, from one aggregate."""
    lo, hi = F.col("lo").cast("string"), F.col("hi").cast("string")
    return raw.agg(F.count("*").alias("rows"), F.min(n.MONTH).alias("lo"), F.max(n.MONTH).alias("hi")).select(
        F.inline(
            F.array(
                F.struct(F.lit("Total de Registros").alias("metrica"), F.col("rows").cast("string").alias("valor")),
                F.struct(F.lit("Período Coberto").alias("metrica"), F.concat(lo, F.lit(" até "), hi).alias("valor")),
            )
        )
    )


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once; copies of a key combine before the shuffle."""
    return rows.groupBy(*keys).agg(F.count("*").alias("copies")).where(F.col("copies") > 1)


def enrich(trips: DataFrame) -> DataFrame:
    """Trip duration in whole seconds, pickup day and pickup month."""
    return trips.withColumns(
        {
            "duration_seconds": whole_seconds(F.col(n.PICKUP), F.col(n.DROPOFF)),
            "pickup_date": F.to_date(n.PICKUP),
            "pickup_period": month_label(n.PICKUP),
        }
    )
