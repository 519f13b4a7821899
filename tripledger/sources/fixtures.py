"""Trip rows derived from the supplied ``lineitem`` table, faults included."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def supplied(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _faulty(usual: Column, faults: dict[int, Column]) -> Column:
    chosen = F
    for bucket, value in faults.items():
        chosen = chosen.when(F.col("h") == bucket, value)
    return chosen.otherwise(usual)


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One trip per line item, about 0.1 % of the rows per kind of fault.

    Buckets 20-29 hold exact copies. Each trip is built once and repeated from there, in
    one scan; as generated columns the values are also not expanded again into every
    condition that looks at them.
    """
    h = F.expr("(l_orderkey * 7 + l_linenumber * 31 + l_partkey * 13 + l_suppkey) % 1000")
    start = F.unix_timestamp(F.col("l_shipdate").cast("timestamp")) + F.expr(
        "(l_orderkey * 977 + l_linenumber * 3571) % 86400"
    )
    copies = F.when(F.col("h").between(20, 29), 2).otherwise(1)
    base = supplied(spark, sf_dir, "lineitem").withColumns({"h": h, "pu": start})

    def after(seconds) -> Column:
        return F.timestamp_seconds(F.col("pu") + seconds)

    null = F.lit(None)
    scaled = F.col("l_extendedprice") / 1000
    trip = F.struct(
        _faulty(F.lit(1) + F.col("l_suppkey") % 2, {0: null, 1: F.lit(6), 2: F.lit(0), 3: F.lit(-1)}).alias("VendorID"),
        _faulty(after(F.lit(0)), {4: null}).alias("tpep_pickup_datetime"),
        _faulty(
            after(F.lit(120) + F.col("l_partkey") % 3600),
            {
                5: null,
                6: after(F.lit(0)),
                7: after(F.lit(-300)),
                8: after(F.lit(90000)),
                9: after(F.lit(30)),
                10: after(F.lit(86400)),
                11: after(F.lit(60)),
            },
        ).alias("tpep_dropoff_datetime"),
        _faulty(
            (F.col("l_quantity").cast("int") % 7).cast("double"),
            {12: null, 13: F.lit(-1.0), 14: F.lit(10.0), 15: F.lit(1.9)},
        ).alias("passenger_count"),
        _faulty(scaled, {16: null, 17: -scaled, 18: F.lit(0.0), 19: F.col("l_extendedprice")}).alias("total_amount"),
        F.trunc("l_shipdate", "month").alias("date_reference"),
        F.when(F.col("l_shipdate") < F.lit("1997-03-01").cast("timestamp_ntz"), F.lit("2001-11-30").cast("date"))
        .otherwise(F.lit("2001-12-01").cast("date"))
        .alias("insertion_date"),
    )
    return base.select(F.inline(F.array_repeat(trip, copies)))


def trips_text(typed: DataFrame) -> DataFrame:
    """The same trips as text, with unreadable values in each column."""
    second = F.col("tpep_pickup_datetime").cast("bigint")

    def text(column: str, modulus: int, junk: str) -> Column:
        return F.when(second % modulus == 0, F.lit(junk)).otherwise(F.col(column).cast("string"))

    return typed.select(
        text("VendorID", 501, "abc").alias("vendor_txt"),
        text("tpep_pickup_datetime", 503, "soon").alias("pickup_txt"),
        text("tpep_dropoff_datetime", 509, "later").alias("dropoff_txt"),
        text("passenger_count", 521, "two").alias("passengers_txt"),
        text("total_amount", 523, "x").alias("amount_txt"),
        "date_reference",
    )
