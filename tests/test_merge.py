from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tripledger.operators import merge
from tripledger.operators.merge import held_keys, insert_only_merge, new_rows
from tripledger.sources.tables import create_table, partition_values

KEYED = StructType([StructField("k", IntegerType()), StructField("v", IntegerType())])


def table(lake, name="t", schema=KEYED, **options):
    create_table(lake.spark, lake.name(name), schema, location=lake.place(name), **options)
    return lake.name(name)


def keys_of(spark, name):
    return sorted((r.k for r in spark.table(name).collect()), key=lambda k: (k is None, k))


def test_null_keys_and_copies(spark, lake):
    name = table(lake)
    spark.createDataFrame([(1, 0)], KEYED).write.insertInto(name)
    source = spark.createDataFrame([(1, 9), (2, 0), (2, 0), (None, 0)], KEYED)
    insert_only_merge(source, name, ["k"])
    assert keys_of(spark, name) == [1, 2, 2, None]
    insert_only_merge(source, name, ["k"])
    assert keys_of(spark, name) == [1, 2, 2, None, None]
    assert spark.table(name).where("k = 1").first().v == 0


def test_null_safe_merge_is_idempotent(spark, lake):
    name = table(lake)
    source = spark.createDataFrame([(1, 0), (None, 0)], KEYED)
    for _ in range(3):
        insert_only_merge(source, name, ["k"], null_safe=True)
    assert keys_of(spark, name) == [1, None]


def test_short_key_loses_later_trips_but_keeps_those_of_one_batch(spark, lake):
    name = table(lake)
    insert_only_merge(spark.createDataFrame([(1, 10), (1, 11)], KEYED), name, ["k"])
    insert_only_merge(spark.createDataFrame([(1, 12)], KEYED), name, ["k"])
    assert sorted(r.v for r in spark.table(name).collect()) == [10, 11]


def test_dedupe_source(spark, lake):
    name = table(lake)
    source = spark.createDataFrame([(1, 0), (1, 0), (1, 1)], KEYED)
    insert_only_merge(source, name, ["k"], dedupe_source=True)
    assert spark.table(name).count() == 2


def test_schema_evolution_both_ways(spark, lake):
    name = table(lake)
    insert_only_merge(spark.createDataFrame([(1, 5)], KEYED), name, ["k"])
    later = spark.createDataFrame([(2, "x")], "k int, extra string")
    with pytest.raises(ValueError, match="extra"):
        insert_only_merge(later, name, ["k"])
    insert_only_merge(later, name, ["k"], evolve=True)
    assert {(r.k, r.v, r.extra) for r in spark.table(name).collect()} == {(1, 5, None), (2, None, "x")}


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    source=st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 5)), st.one_of(st.none(), st.integers(0, 2))),
                    max_size=25),
    target=st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 5)), st.one_of(st.none(), st.integers(0, 2))),
                    max_size=25),
    null_safe=st.booleans(),
    prune=st.booleans(),
)
def test_merges_agree_with_brute_force(spark, source, target, null_safe, prune):
    """Rows (v, p): p is the partition and part of the key, either may be NULL."""
    left = spark.createDataFrame(source, "v int, p int")
    right = spark.createDataFrame(target, "v int, p int")
    found = new_rows(left, right, ["v", "p"], null_safe, "p" if prune else None)
    stored = set(target) if null_safe else {t for t in target if None not in t}
    assert Counter(map(tuple, found.collect())) == Counter(s for s in source if s not in stored)


def plan_of(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


def test_a_key_the_target_holds_very_often_is_one_row_of_the_join(spark):
    target = spark.range(30000).select(F.lit(-1).alias("k"), F.lit(1).alias("v"))
    held = held_keys(target, ["k"])
    assert [r.k for r in held.collect()] == [-1]
    source = spark.range(-2, 3).select(F.col("id").cast("int").alias("k"), F.lit(1).alias("v"))
    assert sorted(r.k for r in new_rows(source, target, ["k"]).collect()) == [-2, 0, 1, 2]


def test_a_key_the_source_has_very_often_is_split(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "32KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        rows = spark.range(0, 90000, numPartitions=8).select(
            F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).cast("int").alias("k"), F.uuid().alias("v")
        )
        found = new_rows(rows, spark.range(10, 2000).select(F.col("id").cast("int").alias("k")), ["k"])
        assert found.where("k = -1").count() == 30000
        found.collect()
        assert "skew=true" in plan_of(found)
    finally:
        for key in settings:
            spark.conf.unset(key)


def test_a_partition_the_target_lacks_needs_no_join(spark):
    source = spark.range(1000).select(F.col("id").cast("int").alias("v"), (F.col("id") % 2).cast("int").alias("p"))
    found = new_rows(source, source.where("p = 0"), ["v", "p"], prune_on="p")
    assert found.where("p = 1").count() == found.count() == 500
    only_new = new_rows(source.where("p = 1"), source.where("p = 0"), ["v", "p"], prune_on="p")
    assert only_new.count() == 500 and "Join" not in plan_of(only_new)


def test_a_merge_of_laid_out_tables_reads_each_part_of_them_once(spark, lake):
    source, target = (table(lake, name, partition_by=("k",)) for name in ("s", "t"))
    spark.createDataFrame([(k, 0) for k in range(6)], KEYED).select("v", "k").write.insertInto(source)
    spark.createDataFrame([(k, 0) for k in range(3, 9)], KEYED).select("v", "k").write.insertInto(target)
    known = [partition_values(spark, name, "k") for name in (source, target)]
    assert known == [set("012345"), set("345678")]
    found = new_rows(spark.table(source), spark.table(target), ["k", "v"], False, "k", *known)
    plan = plan_of(found)
    # Three folders pass, three are joined; the third scan is that of the held keys.
    assert plan.count("InMemoryFileIndex(3 paths)") == 2 and plan.count("FileScan") == 3
    assert sorted(r.k for r in found.collect()) == [0, 1, 2]


def test_only_touched_partitions_of_the_target_are_read(spark, lake):
    name = table(lake, partition_by=("k",))
    spark.createDataFrame([(k, 0) for k in range(20)], KEYED).select("v", "k").write.insertInto(name)
    source = spark.createDataFrame([(3, 0), (4, 1)], KEYED)
    inside = spark.table(name).where("k IN (3, 4)")
    assert len(inside.inputFiles()) == 2
    found = new_rows(source, spark.table(name), ["k", "v"], prune_on="k")
    assert [tuple(r) for r in found.collect()] == [(4, 1)]


@pytest.mark.parametrize("way", [{}, {"resume": True}, {"buckets": 2}])
def test_a_row_of_very_many_copies_is_written_by_several_tasks(spark, lake, monkeypatch, way):
    monkeypatch.setattr(merge, "HEAVY", 1000)
    monkeypatch.setattr(merge, "AT_ONCE", 2000)
    monkeypatch.setattr(merge, "STRETCH", 100)
    options = {"bucket_by": ("k",), "buckets": 2} if "buckets" in way else {}
    name = table(lake, partition_by=("v",), **options)
    often = F.col("id") % 3 == 0
    rows = spark.range(0, 30000, numPartitions=4).select(
        F.when(often, -1).otherwise(F.col("id")).cast("int").alias("k"),
        F.when(often, 1).otherwise(F.col("id") % 5).cast("int").alias("v"),
    )
    most = []

    def write(found, to):
        most.append(found.where("k = -1").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0])
        merge.append(found, to)

    for _ in range(2):
        insert_only_merge(rows, name, ["k"], prune_on="v", layout=(("v",), ()), resume="resume" in way, write=write)
    assert Counter(map(tuple, spark.table(name).select("k", "v").collect())) == Counter(map(tuple, rows.collect()))
    assert most[0] <= 2500 and most[1] is None
