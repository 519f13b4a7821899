"""Writing beside a table and showing the result by catalog pointers.

A run writes its rows into a folder of its own below the table's (``_runs/<id>``, which readers of the table do not list),
laid out by the table's partitions and buckets. Publishing changes the catalog alone: a partition the table has is
pointed to the run's folder, a new one is added there. Whatever breaks before, and whoever reads meanwhile, the table holds its
former rows; a partition changes in one step. What a broken run leaves is in no partition and goes with ``sweep``.

* Replacing: the run holds whole partitions. Each is replaced in one step, several in as many.
* Appending: a table whose last partition column is ``names.RUN`` keeps every run in partitions of its own. All of them
  are added by one statement, so an append is seen whole or not at all.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripledger import names as n
from tripledger.sources.tables import bucket_columns, bucket_count, create_table, table_facts

RUNS = "_runs"


@dataclass(frozen=True)
class Run:
    """Rows written but not yet shown. ``twin`` is a table over the run's folder."""

    spark: SparkSession
    table: str
    twin: str
    folder: str


def partition_columns(spark: SparkSession, table: str) -> list[str]:
    return [c.name for c in spark.catalog.listColumns(table) if c.isPartition]


def write_run(rows: DataFrame, table: str) -> Run:
    """Writes the rows into a new run of the table; where the table keeps runs apart they get the run's name."""
    spark = rows.sparkSession
    parts = partition_columns(spark, table)
    if not parts:
        raise ValueError(f"{table} has no partitions to point elsewhere")
    name = uuid.uuid4().hex[:12]
    if n.RUN in parts:
        rows = rows.withColumn(n.RUN, F.lit(name))
    folder = f"{table_facts(spark, table)['Location']}/{RUNS}/{name}"
    twin = f"{table}__run_{name}"
    layout = {"bucket_by": tuple(bucket_columns(spark, table)), "buckets": bucket_count(spark, table)}
    create_table(spark, twin, spark.table(table).schema, tuple(parts), "rows of a run", folder, **layout)
    rows.select(*spark.table(table).columns).write.insertInto(twin)
    return Run(spark, table, twin, folder)


def _spec(entry: str) -> str:
    """A partition as the catalog lists it (``a=x/b=y``, escaped), as a partition clause."""
    from urllib.parse import unquote

    parts = []
    for part in entry.split("/"):
        column, value = part.split("=", 1)
        value = "NULL" if value == "__HIVE_DEFAULT_PARTITION__" else "'" + unquote(value).replace("\\", "\\\\").replace("'", "\\'") + "'"
        parts.append(f"`{column}` = {value}")
    return f"PARTITION ({', '.join(parts)})"


def _listed(spark: SparkSession, table: str) -> set[str]:
    return {r[0] for r in spark.sql("SHOW PARTITIONS IDENTIFIER(:name)", {"name": table}).collect()}


def publish(runs: list[Run]) -> None:
    """Shows the runs, in order. New partitions of a run come in one statement; a replaced one in a statement each."""
    for run in runs:
        spark = run.spark
        brought, there = _listed(spark, run.twin), _listed(spark, run.table)
        for entry in sorted(brought & there):
            place = f"{run.folder}/{entry}".replace("\\", "\\\\").replace("'", "\\'")
            spark.sql(f"ALTER TABLE IDENTIFIER(:name) {_spec(entry)} SET LOCATION '{place}'", {"name": run.table})
        new = [f"{_spec(entry)} LOCATION '{run.folder}/{entry}'" for entry in sorted(brought - there)]
        if new:
            spark.sql(f"ALTER TABLE IDENTIFIER(:name) ADD {' '.join(new)}", {"name": run.table})
        spark.sql("DROP TABLE IDENTIFIER(:name)", {"name": run.twin})  # the files stay: the table has a location


def partition_places(spark: SparkSession, table: str) -> dict[str, str]:
    """Folder of each partition, by its entry in the catalog: one catalog call per partition."""
    out = {}
    for entry in sorted(_listed(spark, table)):
        told = spark.sql(f"DESCRIBE TABLE EXTENDED IDENTIFIER(:name) {_spec(entry)}", {"name": table}).collect()
        out[entry] = next(r["data_type"] for r in told if r["col_name"] == "Location")
    return out


def sweep(spark: SparkSession, table: str) -> list[str]:
    """Removes what no partition points to: runs that broke or were replaced, and their catalog entries; gives their names.

    To be called while no run of the table is under way and no query reads a replaced partition.
    """
    location = table_facts(spark, table)["Location"]
    used = {place.split(f"/{RUNS}/", 1)[1].split("/", 1)[0] for place in partition_places(spark, table).values() if f"/{RUNS}/" in place}
    schema, _, bare = table.rpartition(".")
    for entry in spark.catalog.listTables(schema or None, f"{bare}__run_*"):
        spark.sql("DROP TABLE IDENTIFIER(:name)", {"name": f"{schema}.{entry.name}" if schema else entry.name})
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{location}/{RUNS}")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    gone = []
    for status in fs.listStatus(path) if fs.exists(path) else []:
        if status.getPath().getName() not in used:
            fs.delete(status.getPath(), True)
            gone.append(status.getPath().getName())
    return sorted(gone)
