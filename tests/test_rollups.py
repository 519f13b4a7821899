from datetime import datetime

from pyspark.sql import functions as F

from tripledger import names as n
from tripledger.operators import rollups
from tripledger.session import work_folder

ROWS = [
    (1, datetime(2023, 1, 31, 23, 59, 59), 10.0, 1),
    (2, datetime(2023, 1, 1), 20.005, 3),
    (1, datetime(2023, 5, 31, 23, 0), 7.0, 0),
    (1, datetime(2023, 5, 2, 23, 0), -7.0, 4),
    (1, datetime(2023, 6, 1), 100.0, 2),
    (1, datetime(2022, 5, 1, 3), 5.0, 6),
    (None, None, 5.0, 6),
    (3, datetime(2023, 5, 9, 1), None, None),
]


def trips(spark):
    df = spark.createDataFrame(ROWS, "vendor_id long, ts timestamp_ntz, total_amount double, passenger_count int")
    return df.select("vendor_id", F.col("ts").cast("timestamp").alias(n.PICKUP), n.AMOUNT, n.PASSENGERS)


def test_monthly_amount(spark):
    rows = [tuple(r) for r in rollups.monthly_amount(trips(spark), 2023, (1, 5)).collect()]
    assert rows == [
        (2023, 1, "2023-01", 15.0, 2, 30.01, 10.0, 20.01),
        (2023, 5, "2023-05", 7.0, 1, 7.0, 7.0, 7.0),
    ]


def test_monthly_amount_without_a_year_keeps_every_row(spark):
    rows = rollups.monthly_amount(trips(spark), columns=["ano", "mes", "total_corridas"]).collect()
    assert [tuple(r) for r in rows] == [(None, None, 1), (2022, 5, 1), (2023, 1, 2), (2023, 5, 1), (2023, 6, 1)]


def test_hourly_passengers(spark):
    rows = [tuple(r) for r in rollups.hourly_passengers(trips(spark), 2023, 5).collect()]
    assert rows == [(23, 4.0, 1, 4, 4, 4)]


def test_profiles(spark):
    profile = rollups.trusted_profile(trips(spark)).first()
    assert (profile.total_registros, profile.vendors_unicos) == (8, 3)
    clean = rollups.clean_profile(trips(spark)).first()
    assert (clean.total_registros, clean.vendors_unicos, clean.media_passageiros) == (5, 2, 3.6)


def test_duplicates(spark):
    rows = spark.createDataFrame([(1, None), (1, None), (2, 1)], "a int, b int")
    assert [tuple(r) for r in rollups.duplicate_keys(rows, ["a", "b"]).collect()] == [(1, None, 2)]


def test_calendar_filters_reach_the_file_scan(spark):
    path = work_folder(spark, "pushdown")
    trips(spark).write.mode("overwrite").parquet(path)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = rollups.monthly_amount(spark.read.parquet(path), 2023, (1, 5))._jdf.queryExecution().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    physical = plan[plan.index("== Physical Plan =="):]
    assert "GreaterThanOrEqual(tpep_pickup_datetime,2023-01-01" in physical
    assert "LessThan(tpep_pickup_datetime,2023-06-01" in physical
    assert "ReadSchema: struct<tpep_pickup_datetime:timestamp,total_amount:double>" in physical
    assert "vendor_id" not in physical.split("ReadSchema")[1]


def test_a_table_by_pickup_month_skips_partitions(spark):
    path = work_folder(spark, "pruning")
    rows = trips(spark).withColumn(n.PICKUP_MONTH, F.trunc(n.PICKUP, "month"))
    rows.write.mode("overwrite").partitionBy(n.PICKUP_MONTH).parquet(path)
    result = rollups.hourly_passengers(spark.read.parquet(path), 2023, 5)
    assert [tuple(r) for r in result.collect()] == [(23, 4.0, 1, 4, 4, 4)]
    assert "PartitionFilters: [isnotnull(data_particao" in result._jdf.queryExecution().toString()
