"""Schemas and tables of the session catalog: creation, layout and inspection."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StringType, StructField, StructType

from tripledger import names as n
from tripledger.operators.rules import TYPE_FLAGS, rules_of
from tripledger.sources import contracts


def schemas(spark: SparkSession) -> DataFrame:
    """Catalogs and schemas the session sees."""
    lines = [(d.catalog, d.name, d.description) for d in spark.catalog.listDatabases()]
    return spark.createDataFrame(lines, "catalog string, schema string, comment string")


def create_schema(spark: SparkSession, name: str, comment: str = "", location: str | None = None) -> None:
    place = f"LOCATION '{_quoted(location)}'" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS IDENTIFIER(:name) COMMENT '{_quoted(comment)}' {place}", {"name": name})


def _quoted(text: str) -> str:
    return text.replace("\\", "\\\\").replace("'", "\\'")


def create_table(
    spark: SparkSession,
    name: str,
    schema: StructType,
    partition_by: tuple[str, ...] = (),
    comment: str = "",
    location: str | None = None,
    file_format: str = "parquet",
    bucket_by: tuple[str, ...] = (),
    buckets: int = 0,
) -> None:
    """Create the table unless it exists, with column and table comments. With ``buckets`` every file holds the rows of one
    bucket, so joins and groupings on the ``bucket_by`` columns need not shuffle the table."""
    parts = f"PARTITIONED BY ({', '.join(f'`{c}`' for c in partition_by)})" if partition_by else ""
    place = f"LOCATION '{_quoted(location)}'" if location else ""
    parts += f" CLUSTERED BY ({', '.join(f'`{c}`' for c in bucket_by)}) INTO {buckets} BUCKETS" if buckets else ""
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS IDENTIFIER(:name) ({schema.toDDL()}) USING {file_format} {parts} "
        f"COMMENT '{_quoted(comment)}' {place}",
        {"name": name},
    )


def _flag_fields() -> list[StructField]:
    return contracts.struct([(flag, "int", "1 if the delivered value did not fit") for flag in TYPE_FLAGS.values()]).fields


def _month_field() -> StructField:
    return StructField(n.PICKUP_MONTH, DateType(), True, {"comment": "first day of the pickup month"})


def create_raw(spark: SparkSession, name: str, location: str | None = None) -> None:
    """The 21 declared columns and the outcome of their casts."""
    schema = StructType(contracts.raw_schema().fields + _flag_fields())
    create_table(spark, name, schema, (n.MONTH,), "conformed trips by month", location)


def create_staging(spark: SparkSession, name: str, location: str | None = None) -> None:
    """Core columns, load dates and the outcome of the casts, laid out by pickup month: a merge
    then reads the months it joins and the months it need not join apart."""
    schema = StructType(contracts.staging_schema().fields + _flag_fields() + [_month_field()])
    create_table(spark, name, schema, (n.PICKUP_MONTH,), "trips awaiting their checks", location)


def _run_field() -> StructField:
    return StructField(n.RUN, StringType(), True, {"comment": "the load that brought the row"})


def create_trusted(
    spark: SparkSession, name: str, location: str | None = None, buckets: int = 0, by_run: bool = False
) -> None:
    """Checked trips, laid out by pickup month so that merges and rollups skip files.

    With ``buckets`` each month is also cut by vendor, pickup and dropoff, and merges do not shuffle the stored keys; a bucket of a month
    should come to some hundred megabytes. ``by_run`` keeps every load in partitions of its own, see ``operators.publish``.
    """
    schema = StructType(contracts.trusted_schema().fields + [_month_field()] + ([_run_field()] if by_run else []))
    parts = (n.PICKUP_MONTH, n.RUN) if by_run else (n.PICKUP_MONTH,)
    create_table(spark, name, schema, parts, "checked trips", location, bucket_by=(n.VENDOR, n.PICKUP, n.DROPOFF), buckets=buckets)


def create_quarantine(
    spark: SparkSession, name: str, pack: str = "coded", location: str | None = None, by_run: bool = False
) -> None:
    schema = contracts.quarantine_schema([r.flag for r in rules_of(pack)])
    schema = StructType(schema.fields + ([_run_field()] if by_run else []))
    parts = (n.QUARANTINE_DAY, n.ERROR_CLASS) + ((n.RUN,) if by_run else ())
    create_table(spark, name, schema, parts, "rejected trips", location)


def table_facts(spark: SparkSession, name: str) -> dict[str, str]:
    """What the catalog tells of a table below its columns, by heading."""
    described = spark.sql("DESCRIBE TABLE EXTENDED IDENTIFIER(:name)", {"name": name}).collect()
    begin = next((k for k, r in enumerate(described) if r["col_name"].startswith("# Detailed Table")), len(described))
    return {r["col_name"]: r["data_type"] for r in described[begin:]}


def bucket_columns(spark: SparkSession, name: str) -> list[str]:
    """The columns a table is bucketed by; none if it is not."""
    told = table_facts(spark, name).get("Bucket Columns", "")
    return re.findall(r"`([^`]+)`", told)


def bucket_count(spark: SparkSession, name: str) -> int:
    return int(table_facts(spark, name).get("Num Buckets", "0"))


def partition_values(spark: SparkSession, name: str, column: str) -> set[str | None]:
    """Values of one partition column of a table, as text, from the catalog: no file is read."""
    values = set()
    for row in spark.sql("SHOW PARTITIONS IDENTIFIER(:name)", {"name": name}).collect():
        parts = dict(part.split("=", 1) for part in row[0].split("/"))
        values.add(None if parts[column] == "__HIVE_DEFAULT_PARTITION__" else unquote(parts[column]))
    return values


def read_table(spark: SparkSession, name: str, schema: StructType) -> DataFrame:
    """A table's columns in declared order (a stored table moves partition columns last)."""
    return spark.table(name).select(*schema.names)


def column_detail(spark: SparkSession, name: str) -> DataFrame:
    """Column names, types and comments of a table."""
    described = spark.sql("DESCRIBE TABLE IDENTIFIER(:name)", {"name": name})
    # Partition columns are listed again below a heading that starts with '#'.
    return described.where(~F.col("col_name").startswith("#")).distinct()


def table_detail(spark: SparkSession, schema: str) -> DataFrame:
    """Every table of a schema with its kind, provider, partition columns and location."""
    lines = []
    for table in spark.catalog.listTables(schema):
        if table.isTemporary:
            continue
        name = f"{schema}.{table.name}"
        wanted = ("Type", "Provider", "Location", "Comment")
        facts = {
            r["col_name"]: r["data_type"]
            for r in spark.sql("DESCRIBE TABLE EXTENDED IDENTIFIER(:name)", {"name": name}).collect()
            if r["col_name"] in wanted
        }
        parts = [c.name for c in spark.catalog.listColumns(name) if c.isPartition]
        lines.append((table.name, *[facts.get(w) for w in wanted], ",".join(parts)))
    return spark.createDataFrame(
        lines, "table_name string, kind string, provider string, location string, comment string, partitions string"
    )
