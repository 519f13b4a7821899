"""All landing files in as few scans as their types allow."""

import uuid

import pytest
from pyspark.sql import functions as F

from tripledger import names as n
from tripledger.operators.conform import EmptyInputError, SchemaError
from tripledger.plans import raw_load
from tripledger.plans.raw_load import RawLoad, load_raw
from tripledger.session import work_folder
from tripledger.sources.landing import file_schemas, landed_months, month_of_path, month_path, scan_months

NOW = "2024-12-01 12:00:00"


def land(spark, months, schemas=("VendorID long, passenger_count double",), template=n.LANDING_TEMPLATE, empty=()):
    """A file per month, with the schemas taking turns; the vendor is the month."""
    base = work_folder(spark, "landing")
    for k, (year, month) in enumerate(months):
        schema = schemas[k % len(schemas)]
        rows = spark.range(0 if (year, month) in empty else 3).select(F.lit(month).alias("VendorID"), F.lit(2).alias("passenger_count"), F.lit("x").alias("more"))
        columns = [F.col(c.split()[0] if c.split()[0].lower() != "vendorid" else "VendorID").cast(c.split()[1]).alias(c.split()[0]) for c in schema.split(", ")]
        rows.select(columns).coalesce(1).write.parquet(month_path(base, year, month, template))
    return base


def months_of(years):
    return [(2020 + k // 12, 1 + k % 12) for k in range(12 * years)]


def jobs_of(spark, run):
    group = f"group-{uuid.uuid4()}"
    spark.sparkContext.setJobGroup(group, "counted")
    try:
        run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_as_many_jobs_for_few_months_as_for_many(spark):
    base = land(spark, months_of(3))
    counts = [
        jobs_of(spark, lambda some=some: raw_load.conformed_months(spark, RawLoad(base, "", "", "", NOW), some).select(n.MONTH).distinct().collect())
        for some in (months_of(3)[:2], months_of(3)[:33], months_of(3))
    ]
    assert counts[1] == counts[2] <= counts[0] + 2  # from 33 folders on Spark lists them by a job, for the footers and the rows


def test_a_column_more_or_another_spelling_is_one_scan(spark):
    some = months_of(1)
    base = land(spark, some, ("VendorID long, passenger_count double", "vendorid long, more string"))
    scans = scan_months(spark, base, some)
    assert len(scans) == 1
    found = scans[0].groupBy(n.MONTH).agg(F.min("vendorid").alias("v"), F.count("more").alias("more")).collect()
    assert {(str(r[0]), r.v, r.more) for r in found} == {(f"2020-{m:02d}-01", m, 0 if m % 2 else 3) for m in range(1, 13)}


@pytest.mark.parametrize("schemas", [
    ("VendorID long, passenger_count double", "VendorID long, passenger_count long"),
    ("VendorID int, passenger_count double", "VendorID long, passenger_count double", "VendorID string, more string"),
])
def test_a_scan_per_type_of_a_column(spark, schemas):
    some = months_of(1)
    base = land(spark, some, schemas)
    groups = file_schemas(spark, [month_path(base, *m) for m in some])
    assert len(groups) == len(schemas)
    assert sorted(p for paths, _ in groups for p in paths) == sorted(month_path(base, *m) for m in some)
    rows = raw_load.conformed_months(spark, RawLoad(base, "", "", "", NOW), some)
    found = rows.select(F.col(n.MONTH).cast("string"), "VendorID", "passenger_count").distinct().collect()
    kept = {m: None if "more" in schemas[(m - 1) % len(schemas)] else 2.0 for m in range(1, 13)}
    assert {tuple(r) for r in found} == {(f"2020-{m:02d}-01", m, kept[m]) for m in range(1, 13)}


def test_a_load_of_mixed_files_in_both_ways(spark, lake):
    some = months_of(1)[:4]
    schemas = ("VendorID long, passenger_count double", "VendorID string, passenger_count string")
    base = land(spark, some, schemas)
    for publish in ("commit", "pointer"):
        table = f"{lake.schema}.raw_{publish}"
        for _ in range(2):
            load_raw(spark, RawLoad(base, table, "2020-01", "2020-04", NOW, publish=publish))
        found = spark.table(table).groupBy(n.MONTH).agg(F.count("*").alias("c"), F.sum("passenger_count").alias("p")).collect()
        assert {(str(r[0]), r.c, r.p) for r in found} == {(f"2020-{m:02d}-01", 3, 6.0) for m in range(1, 5)}


def test_a_broken_publish_leaves_the_old_months_and_a_rerun_brings_the_new_ones(spark, lake, monkeypatch):
    job = RawLoad(land(spark, months_of(1)[:3]), lake.name("raw_p"), "2020-01", "2020-03", NOW, publish="pointer")
    load_raw(spark, job)
    before = sorted(map(tuple, spark.table(job.table).collect()), key=str)
    later = RawLoad(land(spark, months_of(1)[:3], ("VendorID long, passenger_count double, more string",)), job.table, "2020-01", "2020-03",
                    "2024-12-02 12:00:00", publish="pointer")

    def lost(runs):
        raise RuntimeError("driver lost")

    with monkeypatch.context() as m:
        m.setattr(raw_load, "publish", lost)
        with pytest.raises(RuntimeError, match="driver lost"):
            load_raw(spark, later)
    assert sorted(map(tuple, spark.table(job.table).collect()), key=str) == before
    load_raw(spark, later)
    assert {(str(r[0]), r[1]) for r in spark.table(job.table).groupBy(n.LOADED).count().collect()} == {("2024-12-02", 9)}


def test_missing_empty_and_surplus(spark, lake):
    base = land(spark, months_of(1)[:3], empty={(2020, 2)})
    with pytest.raises(EmptyInputError, match="2020-02"):
        load_raw(spark, RawLoad(base, lake.name("raw_m"), "2020-01", "2020-03", NOW))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        load_raw(spark, RawLoad(base, lake.name("raw_m"), "2020-01", "2020-04", NOW))
    base = land(spark, months_of(1)[:2], ("VendorID long", "VendorID long, more string"))
    with pytest.raises(SchemaError, match="more"):
        load_raw(spark, RawLoad(base, lake.name("raw_m"), "2020-01", "2020-02", NOW, extras="fail"))
    assert landed_months(spark, base).count() == 2


@pytest.mark.parametrize(("template", "path", "found"), [
    (n.LANDING_TEMPLATE, "s3a://b/yellow/yellow_tripdata_2023-04.parquet", "2023-04-01"),
    (n.LANDING_TEMPLATE, "s3a://b/yellow/yellow_tripdata_2023-04.parquet/part-0.parquet", "2023-04-01"),
    ("month={year}-{month:02d}", "file:/a/month=2019-01/month=2023-12/part.parquet", "2023-12-01"),
    ("{month}/of {year}.parquet", "file:/x/7/of%202021.parquet", "2021-07-01"),
])
def test_the_month_of_a_path(spark, template, path, found):
    assert str(spark.range(1).select(month_of_path(F.lit(path), template)).first()[0]) == found


def test_a_path_without_month_is_an_error(spark):
    with pytest.raises(Exception, match="no month in"):
        spark.range(1).select(month_of_path(F.lit("file:/x/other.parquet"))).collect()
