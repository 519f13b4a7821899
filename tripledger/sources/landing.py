"""Monthly Parquet files: reading, and finding the months not yet landed."""

from __future__ import annotations

import re
from datetime import date
from string import Formatter
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tripledger import names as n
from tripledger.functions.columns import moment
from tripledger.functions.months import day_in_zone


def month_path(base: str, year: int, month: int, template: str = n.LANDING_TEMPLATE) -> str:
    return f"{base.rstrip('/')}/{template.format(year=year, month=month)}"


def scan_month(
    spark: SparkSession, base: str, year: int, month: int, template: str = n.LANDING_TEMPLATE
) -> DataFrame:
    """One month as stored; a month that has not landed is an error."""
    return spark.read.parquet(month_path(base, year, month, template))


def file_schemas(spark: SparkSession, paths: list[str]) -> list[tuple[list[str], StructType]]:
    """The paths grouped so that each group can be read as one table, with its columns.

    One job reads the footers of all files on the executors and merges their schemas: a column that some files lack is
    NULL there. Only where types of a column contradict each other are the paths, which are in order of time, halved, so a change
    of type costs a number of jobs that grows with the logarithm of the number of paths; groups of equal types are
    then put together again. A path whose own files contradict each other is an error.
    """
    groups: list[tuple[list[str], StructType]] = []
    for some, schema in _mergeable(spark, paths):
        for k, (known, merged) in enumerate(groups):
            both = _union(merged, schema)
            if both is not None:
                groups[k] = (known + some, both)
                break
        else:
            groups.append((some, schema))
    return groups


def _mergeable(spark: SparkSession, paths: list[str]) -> list[tuple[list[str], StructType]]:
    try:
        return [(paths, spark.read.option("mergeSchema", "true").parquet(*paths).schema)]
    except Exception as error:
        if len(paths) == 1 or "CANNOT_MERGE_SCHEMAS" not in str(error):
            raise
    middle = len(paths) // 2
    return _mergeable(spark, paths[:middle]) + _mergeable(spark, paths[middle:])


def _union(left: StructType, right: StructType) -> StructType | None:
    """All columns of both, by name regardless of case; None if one has two types."""
    types = {f.name.lower(): f.dataType for f in left}
    if any(types.get(f.name.lower(), f.dataType) != f.dataType for f in right):
        return None
    return StructType(left.fields + [f for f in right if f.name.lower() not in types])


def month_of_path(path: Column, template: str = n.LANDING_TEMPLATE) -> Column:
    """First day of the month that the template gives a file of this path (or a file below it); an error if it gives none."""
    pattern, order = "", []
    for text, name, _, _ in Formatter().parse(template):
        pattern += re.escape(quote(text, safe="/:=,+&@$!*'();~"))
        if name:
            pattern += "([0-9]+)"
            order.append(name)
    # The last place in the path that fits is meant: folders above may look alike.
    parts = {name: F.regexp_extract(path, f"^.*/{pattern}(?:/.*)?$", k + 1) for k, name in enumerate(order)}
    found = F.make_date(parts["year"].cast("int"), parts["month"].cast("int"), F.lit(1))
    fits = path.rlike(f"^.*/{pattern}(?:/.*)?$")
    return F.when(fits, found).otherwise(F.raise_error(F.concat(F.lit("no month in "), path)).cast("date"))


def scan_months(
    spark: SparkSession, base: str, months: list[tuple[int, int]], template: str = n.LANDING_TEMPLATE
) -> list[DataFrame]:
    """All months as stored, each row with the month of its file: one scan for all months whose files agree in types,
    usually one in all. A month that has not landed is an error."""
    paths = [month_path(base, year, month, template) for year, month in months]
    scans = []
    for some, schema in file_schemas(spark, paths):
        rows = spark.read.schema(schema).parquet(*some)
        scans.append(rows.withColumn(n.MONTH, month_of_path(rows.metadataColumn("_metadata")["file_path"], template)))
    return scans


def with_load_metadata(
    df: DataFrame, year: int | None, month: int | None, as_of: str | None = None, zone: str = n.LANDING_ZONE,
    cast: bool = True,
) -> DataFrame:
    """Add the month of the file and the load day in the operator's time zone. Rows of ``scan_months`` have their month: they
    are given without ``year`` and ``month``.

    ``as_of`` is a UTC moment as text; without it the query's start time is used. Pickup and dropoff
    become timestamps, NULL where they are not readable; ``cast=False`` leaves them to ``conform``,
    which records what it could not read.
    """
    now = moment(as_of) if as_of else F.current_timestamp()
    times = {c: F.col(c).try_cast("timestamp") for c in (n.PICKUP, n.DROPOFF)} if cast else {}
    known = {} if year is None or month is None else {n.MONTH: F.lit(date(year, month, 1))}
    return df.withColumns({**times, **known, n.LOADED: day_in_zone(now, zone)})


def landed_months(
    spark: SparkSession,
    base: str,
    pattern: str = r"yellow_tripdata_([0-9]{4}-(?:0[1-9]|1[0-2]))\.parquet",
) -> DataFrame:
    """Months found below a folder, from file names alone: no file is opened."""
    listing = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base).select("path")
    )
    month = F.to_date(F.concat(F.regexp_extract("path", pattern, 1), F.lit("-01")))
    return listing.where(F.col("path").rlike(pattern)).select(month.alias("month")).distinct()


def landing_gaps(spine: DataFrame, landed: DataFrame) -> DataFrame:
    """Months of the spine that have not landed; both sides are a few rows per year."""
    return spine.join(landed, "month", "left_anti")
