from datetime import date

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tripledger.operators import writers
from tripledger.session import work_folder
from tripledger.sources import contracts, landing, tables

DAYS = "v int, date_reference date"
MAR, APR = date(2023, 3, 1), date(2023, 4, 1)


def months_table(lake):
    schema = contracts.struct([("v", "int", "it's a value"), ("date_reference", "date", "")])
    tables.create_table(lake.spark, lake.name("m"), schema, ("date_reference",), "it's a table", lake.place("m"))
    return lake.name("m")


def held(spark, name):
    return sorted((r.date_reference, r.v) for r in spark.table(name).collect())


def test_replacing_a_month_leaves_the_others(spark, lake):
    name = months_table(lake)
    writers.replace_partitions(spark.createDataFrame([(1, MAR), (2, APR)], DAYS), name)
    for _ in range(2):
        writers.replace_partitions(spark.createDataFrame([(7, APR), (8, APR)], DAYS), name)
    assert held(spark, name) == [(MAR, 1), (APR, 7), (APR, 8)]
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode").lower() == "static"


def test_an_empty_batch_replaces_nothing(spark, lake):
    name = months_table(lake)
    writers.append(spark.createDataFrame([(1, MAR)], DAYS), name)
    writers.replace_partitions(spark.createDataFrame([], DAYS), name)
    assert held(spark, name) == [(MAR, 1)]


def test_append_goes_by_name_and_truncate_empties(spark, lake):
    name = months_table(lake)
    writers.append(spark.createDataFrame([(MAR, 1)], "date_reference date, v int"), name)
    assert held(spark, name) == [(MAR, 1)]
    writers.truncate(spark, name)
    assert held(spark, name) == []


def test_table_creation_is_repeatable_and_keeps_comments(spark, lake):
    months_table(lake)
    name = months_table(lake)
    detail = {r.col_name: r for r in tables.column_detail(spark, name).collect()}
    assert detail["v"].comment == "it's a value" and detail["date_reference"].data_type == "date"
    line = tables.table_detail(spark, lake.schema).first()
    assert (line.table_name, line.provider, line.comment, line.partitions) == (
        "m", "parquet", "it's a table", "date_reference"
    )


def test_schemas_are_listed(spark, lake):
    assert lake.schema in {r.schema for r in tables.schemas(spark).collect()}
    tables.create_schema(spark, lake.schema, "again")


def test_one_month_with_nearly_all_rows_is_written_by_many_tasks(spark):
    path = work_folder(spark, "skew")
    rows = spark.range(200_000, numPartitions=8).select(
        F.when(F.col("id") % 100 == 0, F.lit(MAR)).otherwise(F.lit(APR)).alias("date_reference"),
        F.sha2(F.col("id").cast("string"), 256).alias("payload"),
        F.lit(1).alias("VendorID"),
    )
    sizes = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "1MB",
             "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64KB"}
    for key, value in sizes.items():
        spark.conf.set(key, value)
    try:
        writers.replace_month_files(rows, path, "date_reference", ("VendorID",))
    finally:
        for key in sizes:
            spark.conf.unset(key)
    files = spark.read.parquet(path).where(F.col("date_reference") == F.lit(APR)).inputFiles()
    assert len(files) > 3
    assert spark.read.parquet(path).count() == 200_000


AWKWARD = [None, "", " a ", 'say "x", y', "two\nlines", "\r\n", "\\N", "\\E", "\\", "\\\\n", "a\\nb", "#", "é, ü", '"']


def test_csv_gives_every_value_back(spark):
    path = work_folder(spark, "csv")
    rows = spark.createDataFrame(list(enumerate(AWKWARD)) + [(None, "x")], "v int, `t.x` string").select(
        "*", F.expr("timestamp_micros(1234567890123456 + v) AS at"), F.expr("timestamp_ntz'2020-01-02 03:04:05.000007' AS n"),
        F.expr("CAST(v AS DOUBLE) / 7 AS d"), F.expr("date_add(DATE'1969-12-30', v) AS day"),
    )
    writers.export_csv(rows, path)
    back = writers.read_csv(spark, path, rows.schema)
    assert back.dtypes == rows.dtypes
    assert sorted(back.collect(), key=str) == sorted(rows.collect(), key=str)
    assert spark.read.text(path).count() == rows.count() + len(spark.read.text(path).inputFiles())
    with pytest.raises(PySparkException, match="zero character"):
        writers.export_csv(spark.createDataFrame([("a\0b",)], "t string"), path)


def test_landing_scan_listing_and_gaps(spark):
    base = work_folder(spark, "landing")
    for month in (1, 2, 4):
        spark.range(3).write.parquet(landing.month_path(base, 2023, month))
    assert landing.scan_month(spark, base, 2023, 2).count() == 3
    with pytest.raises(PySparkException, match="PATH_NOT_FOUND"):
        landing.scan_month(spark, base, 2023, 3).count()
    landed = landing.landed_months(spark, base)
    assert landed.count() == 3
    from tripledger.functions.months import month_spine

    gaps = landing.landing_gaps(month_spine(spark, "2023-01", "2023-05"), landed)
    assert sorted(r.month for r in gaps.collect()) == [date(2023, 3, 1), date(2023, 5, 1)]


def test_work_folder_lies_below_the_shared_folder(spark):
    shared = spark.conf.get("spark.checkpoint.dir", None)
    folder = work_folder(spark, "x")
    assert "/tripledger/x-" in folder
    assert not shared or folder.startswith(shared)
