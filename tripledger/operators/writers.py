"""Writers: layout, append, partition replacement and exports."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from tripledger.session import setting


def arrange(df: DataFrame, partition_by: tuple[str, ...], sort_by: tuple[str, ...] = ()) -> DataFrame:
    """Gather rows by partition for few, well-sized files, ordered so that readers can skip.

    A rebalance lets Spark split a month that holds a large share of the rows over many
    tasks and merge small ones; a plain repartition would send each whole month to one task.
    """
    if not partition_by:
        return df
    return gather(df, *partition_by).sortWithinPartitions(*partition_by, *sort_by)


def gather(df: DataFrame, *by: str) -> DataFrame:
    """The gathering of ``arrange`` alone, for writers that sort by themselves."""
    return df.hint("rebalance", *[F.col(c) for c in by])


def append(df: DataFrame, table: str) -> None:
    _in_table_order(df, table).write.insertInto(table)


def replace_partitions(df: DataFrame, table: str) -> None:
    """Replace exactly the partitions the batch holds rows for; others stay.

    Old files go when the job commits, so a run that fails before leaves the table as it was, and a
    repeated run gives the same rows. The commit itself deletes folders and renames others: on
    storage without atomic renames a driver lost in it can leave a month absent until the rerun.
    """
    with setting(df.sparkSession, "spark.sql.sources.partitionOverwriteMode", "dynamic"):
        _in_table_order(df, table).write.insertInto(table, overwrite=True)


def truncate(spark: SparkSession, table: str) -> None:
    """Empty a table. TRUNCATE refuses tables with a location of their own; this does not."""
    nothing = spark.createDataFrame([], spark.table(table).schema)
    with setting(spark, "spark.sql.sources.partitionOverwriteMode", "static"):
        nothing.write.insertInto(table, overwrite=True)


def _in_table_order(df: DataFrame, table: str) -> DataFrame:
    return df.select(*df.sparkSession.table(table).columns)


def replace_month_files(df: DataFrame, path: str, month: str, sort_by: tuple[str, ...] = ()) -> None:
    """Path form of the replacement: files below ``path``, one folder per month."""
    arranged = arrange(df, (month,), sort_by)
    arranged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(month).parquet(path)


def export_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


# Text is escaped so that a record is one line, whatever it holds, and files can be split: a backslash
# doubles, line breaks become \\n and \\r, NULL is \\N and empty text \\E. Other types leave NULL empty.
CSV_OPTIONS = {
    "header": "true",
    "quote": '"',
    "escape": '"',
    "nullValue": "",
    "emptyValue": "",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
    "timestampFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS",
    "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS",
    "timeZone": "UTC",
}


def _escaped(column: Column) -> Column:
    text = F.replace(column, F.lit("\\"), F.lit("\\\\"))
    text = F.replace(F.replace(text, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))
    return F.when(column.isNull(), "\\N").when(column == "", "\\E").otherwise(text)


def _restored(column: Column) -> Column:
    # Doubled backslashes are set aside first: the character after one of them is not an escape.
    kept = F.lit("\0")
    text = F.replace(column, F.lit("\\\\"), kept)
    text = F.replace(F.replace(text, F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r"))
    return F.when(column == "\\N", None).when(column == "\\E", "").otherwise(F.replace(text, kept, F.lit("\\")))


def _of_text(schema: StructType, change) -> list[Column]:
    columns = [(f, F.col("`" + f.name.replace("`", "``") + "`")) for f in schema]
    return [(change(c) if isinstance(f.dataType, StringType) else c).alias(f.name) for f, c in columns]


def export_csv(df: DataFrame, path: str) -> None:
    """CSV with a header line per file, written in parallel; ``read_csv`` gives every value back.

    A zero character in a text is not representable and an error.
    """
    sound = [~F.coalesce(F.contains(c, F.lit("\0")), F.lit(False)) for c in _of_text(df.schema, lambda c: c.cast("string"))]
    texts = [s for s, f in zip(sound, df.schema, strict=True) if isinstance(f.dataType, StringType)]
    if texts:
        df = df.where(F.assert_true(reduce(and_, texts), F.lit("a text holds a zero character")).isNull())
    df.select(_of_text(df.schema, _escaped)).write.mode("overwrite").options(**CSV_OPTIONS).csv(path)


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.options(**CSV_OPTIONS).schema(schema).csv(path).select(_of_text(schema, _restored))
