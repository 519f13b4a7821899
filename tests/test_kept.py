"""Kept partial aggregates: only changed months are read, and the rollups equal those over all rows."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tripledger import names as n
from tripledger.operators import kept, rollups
from tripledger.operators.publish import publish, write_run
from tripledger.operators.writers import append, replace_partitions


def trips(spark, rows):
    """(vendor, pickup, passengers, amount) as checked trips."""
    found = spark.createDataFrame(rows, "v int, p timestamp, c int, a double")
    return found.select(
        F.col("v").alias(n.VENDOR), F.col("p").alias(n.PICKUP), F.col("p").alias(n.DROPOFF), F.col("c").alias(n.PASSENGERS),
        F.col("a").alias(n.AMOUNT), F.trunc("p", "MM").alias(n.PICKUP_MONTH),
    )


def month(k, amount=1.5):
    return [(v, datetime(2023, k, 1 + v, h, 30), c, amount * c) for v in (1, 2) for h in (0, 7) for c in (0, 1, 4)]


def same(found, wanted):
    assert found.schema.simpleString() == wanted.schema.simpleString()
    assert [tuple(r) for r in found.collect()] == [tuple(r) for r in wanted.collect()]


def check(spark, name, table):
    some, rows = spark.table(name), spark.table(table)
    same(kept.monthly_amount(some), rollups.monthly_amount(rows))
    same(kept.monthly_amount(some, 2023, (2, 3)), rollups.monthly_amount(rows, 2023, (2, 3)))
    same(kept.hourly_passengers(some, 2023, 2), rollups.hourly_passengers(rows, 2023, 2))
    same(kept.trusted_profile(some), rollups.trusted_profile(rows))
    same(kept.clean_profile(some), rollups.clean_profile(rows))


@pytest.fixture
def pair(spark, lake):
    kept.create_kept(spark, lake.name("kept"), lake.place("kept"))
    return lake.trusted(), lake.name("kept")


def test_only_touched_months_are_computed(spark, pair):
    table, name = pair
    assert kept.refresh(spark, table, name) == []
    check(spark, name, table)  # of empty tables
    append(trips(spark, month(1) + month(2)), table)
    assert kept.refresh(spark, table, name) == [date(2023, 1, 1), date(2023, 2, 1)]
    check(spark, name, table)
    assert kept.refresh(spark, table, name) == []
    append(trips(spark, month(3) + month(2)[:5]), table)  # a new month, and more of one that was there
    assert kept.refresh(spark, table, name) == [date(2023, 2, 1), date(2023, 3, 1)]
    check(spark, name, table)
    replace_partitions(trips(spark, month(1, 2.5)), table)  # as many rows as before, others
    assert kept.refresh(spark, table, name) == [date(2023, 1, 1)]
    check(spark, name, table)


def test_the_scan_is_of_the_touched_months_and_marks_read_no_column(spark, pair):
    table, name = pair
    append(trips(spark, month(1) + month(2)), table)
    plan = kept.partials(spark.table(table).where(kept._among([date(2023, 2, 1)])))._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "2023-02-01" in plan.split("PartitionFilters: [")[1].split("]")[0]
    marks = kept.file_marks(spark.table(table))._jdf.queryExecution().toString()
    assert "ReadSchema: struct<>" in marks


def test_a_month_that_goes_and_comes_back(spark, pair):
    table, name = pair
    append(trips(spark, month(1) + month(2)), table)
    kept.refresh(spark, table, name)
    spark.sql(f"ALTER TABLE {table} DROP PARTITION ({n.PICKUP_MONTH} = DATE'2023-02-01')")
    assert kept.refresh(spark, table, name) == []
    assert kept.trusted_profile(spark.table(name)).first()[0] == 12
    check(spark, name, table)
    replace_partitions(trips(spark, month(2)[:4]), table)
    assert kept.refresh(spark, table, name) == [date(2023, 2, 1)]
    check(spark, name, table)


def test_a_broken_refresh_is_made_good(spark, pair, monkeypatch):
    table, name = pair
    append(trips(spark, month(1)), table)

    def lost(rows, table):
        raise RuntimeError("driver lost")

    with monkeypatch.context() as m:
        m.setattr(kept, "replace_partitions", lost)
        with pytest.raises(RuntimeError, match="driver lost"):
            kept.refresh(spark, table, name)
    assert kept.refresh(spark, table, name) == [date(2023, 1, 1)]
    check(spark, name, table)


def test_runs_published_by_pointer_are_seen(spark, lake):
    table, name = lake.trusted(by_run=True, buckets=2), lake.name("kept")
    kept.create_kept(spark, name, lake.place("kept"))
    for k in (1, 2, 2):
        publish([write_run(trips(spark, month(k)), table)])
        assert kept.refresh(spark, table, name) == [date(2023, k, 1)]
    check(spark, name, table)


def test_awkward_rows(spark, pair):
    table, name = pair
    odd = [(None, None, None, None), (None, datetime(2023, 5, 1), None, -1.0), (3, datetime(2023, 5, 1, 4), 2, None), (3, datetime(2023, 5, 1, 4), -2, 4.0)]
    append(trips(spark, odd + odd), table)
    assert kept.refresh(spark, table, name) == [date(2023, 5, 1), None]
    check(spark, name, table)
    assert kept.refresh(spark, table, name) == []
