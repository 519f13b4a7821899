"""Bucketed merges, counted reruns, and runs shown by catalog pointers."""

from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DoubleType, IntegerType, StringType, StructField, StructType

from tripledger.operators import merge
from tripledger.operators.merge import BY_SOME_KEYS, insert_only_merge, lacking_copies
from tripledger.operators.publish import partition_places, publish, sweep, write_run
from tripledger.session import setting
from tripledger.sources.tables import bucket_columns, bucket_count, create_table

KEYED = StructType([StructField("k", IntegerType()), StructField("a", DoubleType()), StructField("m", IntegerType())])


def table(lake, name="t", **options):
    create_table(lake.spark, lake.name(name), KEYED, ("m",), location=lake.place(name), **options)
    return lake.name(name)


def rows_of(spark, name):
    return Counter((r.k, r.a, r.m) for r in spark.table(name).collect())


def frame(spark, rows):
    return spark.createDataFrame(rows, KEYED)


ROW = st.tuples(st.one_of(st.none(), st.integers(0, 3)), st.sampled_from([None, 0.5, 1.5]), st.sampled_from([1, 2]))


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(source=st.lists(ROW, max_size=20), target=st.lists(ROW, max_size=20), null_safe=st.booleans(), resume=st.booleans())
def test_missing_copies_agree_with_brute_force(spark, source, target, null_safe, resume):
    found = lacking_copies(frame(spark, source), frame(spark, target), ["k", "a"], resume, null_safe)
    held = Counter((k, a) for k, a, _ in target if null_safe or None not in (k, a))
    wanted = Counter()
    for row, copies in Counter(source).items():
        there = held[row[:2]]
        wanted[row] = max(copies - there, 0) if resume else copies * (there == 0)
    assert Counter(tuple(r) for r in found.collect()) == +wanted


def test_more_copies_than_an_array_takes(spark, monkeypatch):
    monkeypatch.setattr(merge, "STRETCH", 7)
    rows = [(1, 1.0, 1)] * 50 + [(2, 1.0, 1)] * 7 + [(3, 1.0, 1)] * 8
    held = [(1, 1.0, 1)] * 3
    found = lacking_copies(frame(spark, rows), frame(spark, held), ["k", "a"], resume=True)
    assert Counter(r.k for r in found.collect()) == {1: 47, 2: 7, 3: 8}


def test_resume_needs_the_whole_row_as_key(spark, lake):
    with pytest.raises(ValueError, match="all columns"):
        insert_only_merge(frame(spark, [(1, 1.0, 1)]), table(lake), ["k"], resume=True)


def exchanges_above_the_scan(plan):
    """Exchanges on the way from the scan of the table up to the join."""
    lines = plan.splitlines()
    scan = next(k for k, x in enumerate(lines) if "FileScan parquet" in x)
    depth = len(lines[scan]) - len(lines[scan].lstrip(" :+-"))
    found = 0
    for line in reversed(lines[:scan]):
        at = len(line) - len(line.lstrip(" :+-"))
        if at < depth:
            depth = at
            if "Join" in line:
                return found
            found += "Exchange" in line
    raise AssertionError("no join")


def test_the_stored_keys_of_a_bucketed_table_are_not_shuffled(spark, lake, capsys):
    plans = {}
    for name, options in (("plain", {}), ("cut", {"bucket_by": ("k",), "buckets": 3})):
        t = table(lake, name, **options)
        insert_only_merge(frame(spark, [(k, 1.0, 1) for k in range(50)]), t, ["k", "a"], prune_on="m")
        buckets = (bucket_count(spark, t), bucket_columns(spark, t)) if options else None
        with setting(spark, BY_SOME_KEYS, "false"), setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):
            lacking_copies(frame(spark, [(1, 1.0, 1)] * 9), spark.table(t), ["k", "a"], buckets=buckets).explain()
        plans[name] = capsys.readouterr().out
    assert exchanges_above_the_scan(plans["plain"]) >= 1
    assert exchanges_above_the_scan(plans["cut"]) == 0
    assert spark.conf.get(BY_SOME_KEYS) == "true"


def test_a_bucketed_merge_inserts_once_and_in_buckets(spark, lake):
    t = table(lake, bucket_by=("k",), buckets=4)
    rows = [(k % 40, float(k % 3), 1 + k % 2) for k in range(400)] + [(7, 9.0, 1)] * 300 + [(None, 1.0, 2)]
    for _ in range(2):
        insert_only_merge(frame(spark, rows), t, ["k", "a"], prune_on="m")
    wanted = Counter(rows)
    wanted[None, 1.0, 2] += 1  # a NULL key never meets
    assert rows_of(spark, t) == wanted
    files = [f.rsplit("/", 1) for f in spark.table(t).inputFiles()]
    assert max(Counter(folder for folder, _ in files).values()) <= 2 * 4
    one_bucket = spark.table(t).where("k = 7").select(F.expr("count(distinct regexp_extract(_metadata.file_name, '_([0-9]+)[.]c', 1))"))
    assert one_bucket.first()[0] == 1


def test_whatever_breaks_before_the_pointer_changes_nothing(spark, lake):
    t = table(lake)
    publish([write_run(frame(spark, [(1, 1.0, 1), (2, 1.0, 2)]), t)])
    old = rows_of(spark, t)
    new = frame(spark, [(5, 5.0, 1), (6, 6.0, 3), (7, 7.0, None)])
    write_run(new, t)  # the driver is lost here
    assert rows_of(spark, t) == old
    spark.catalog.refreshTable(t)
    assert rows_of(spark, t) == old
    publish([write_run(new, t)])  # the rerun
    assert rows_of(spark, t) == Counter([(5, 5.0, 1), (6, 6.0, 3), (7, 7.0, None), (2, 1.0, 2)])
    gone = sweep(spark, t)
    assert len(gone) == 1  # the broken run; the first one still holds m = 2
    assert rows_of(spark, t) == Counter([(5, 5.0, 1), (6, 6.0, 3), (7, 7.0, None), (2, 1.0, 2)])
    assert all("/_runs/" in place for place in partition_places(spark, t).values())
    assert [x.name for x in spark.catalog.listTables(lake.schema)] == ["t"]
    assert sweep(spark, t) == []


def test_an_append_is_shown_whole(spark, lake):
    schema = StructType([*KEYED.fields, StructField("load_run", StringType())])
    t = lake.name("apart")
    create_table(spark, t, schema, ("m", "load_run"), location=lake.place("apart"))
    for rows in ([(1, 1.0, 1)], [(1, 1.0, 1), (2, 2.0, 1), (3, 3.0, 2)]):
        publish([write_run(frame(spark, rows), t)])
    write_run(frame(spark, [(9, 9.0, 1)]), t)
    assert rows_of(spark, t) == Counter([(1, 1.0, 1), (1, 1.0, 1), (2, 2.0, 1), (3, 3.0, 2)])
    insert_only_merge(frame(spark, [(2, 2.0, 1), (4, 4.0, 1)]), t, ["k", "a"], prune_on="m", write=lambda r, x: publish([write_run(r, x)]))
    assert rows_of(spark, t)[4, 4.0, 1] == 1 and rows_of(spark, t)[2, 2.0, 1] == 1


def test_partitions_of_any_text_are_pointed_to(spark, lake):
    schema = "k int, day date, p string"
    t = lake.name("texts")
    create_table(spark, t, spark.createDataFrame([], schema).schema, ("day", "p"), location=lake.place("texts"))
    texts = ["it's", "a/b", "x=y", "50%", "back\\slash", "ü", "two words"]
    rows = spark.createDataFrame([(k, None, p) for k, p in enumerate(texts)], schema).withColumn("day", F.lit("2023-01-01").cast(DateType()))
    for _ in range(2):
        publish([write_run(rows, t)])
    assert {(r.k, r.p) for r in spark.table(t).collect()} == set(enumerate(texts))
    assert len(sweep(spark, t)) == 1
    assert spark.table(t).count() == len(texts)


def test_a_table_without_partitions_cannot_be_published(spark, lake):
    create_table(spark, lake.name("flat"), KEYED, location=lake.place("flat"))
    with pytest.raises(ValueError, match="no partitions"):
        write_run(frame(spark, []), lake.name("flat"))


def test_a_bucketed_merge_meets_groups_of_partitions_apart(spark, lake, monkeypatch):
    monkeypatch.setattr(merge, "MET_AT_ONCE", 30)
    t = table(lake, bucket_by=("k",), buckets=2)
    rows = [(k, float(k % 3), k % 10) for k in range(400)] + [(1, 1.0, None)] * 3
    insert_only_merge(frame(spark, rows[:300]), t, ["k", "a"], prune_on="m")
    met, tasks, plain = [], [], merge.lacking_copies

    def noted(source, target, *more, **options):
        met.append(target.count())
        return plain(source, target, *more, **options)

    def write(found, name):
        tasks.append(found.rdd.getNumPartitions())
        merge.append(found, name)

    monkeypatch.setattr(merge, "lacking_copies", noted)
    insert_only_merge(frame(spark, rows), t, ["k", "a"], prune_on="m", write=write)
    assert rows_of(spark, t) == Counter(rows)
    assert met == [30] * 10 and tasks[0] >= 10 * 2  # a task per group and bucket, not per bucket
    insert_only_merge(frame(spark, rows), t, ["k", "a"], prune_on="m", resume=True)
    assert rows_of(spark, t) == Counter(rows)
    assert [x.name for x in spark.catalog.listTables(lake.schema)] == ["t"]


def test_both_sides_of_a_resumed_merge_are_shuffled_once(spark, lake):
    t = table(lake)
    rows = [(k % 30, 1.0, k % 30 % 3) for k in range(90)] + [(None, 2.0, None)] * 2
    plans = []

    def write(found, name):
        plans.append(found._jdf.queryExecution().executedPlan().toString())
        merge.append(found, name)

    merge.append(frame(spark, rows[:40]), t)
    with setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):
        insert_only_merge(frame(spark, rows), t, ["k", "a"], prune_on="m", resume=True, write=write)
    assert rows_of(spark, t) == Counter(rows)
    assert plans[0].count("Exchange hashpartitioning") == 1  # of both sides, each once
