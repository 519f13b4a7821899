"""Insert-only merge: append the source rows whose key the target does not hold.

Semantics: keys compare with ``=``, so a NULL key never matches and such a row is
inserted on every run; copies within the source are all inserted; target rows never
change. One writer at a time: the check and the append are two steps.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripledger import names as n
from tripledger.operators.writers import append, arrange, gather
from tripledger.session import setting, work_folder
from tripledger.sources.tables import bucket_columns, bucket_count, create_table, partition_values

#: Lets a join on more columns use a table's buckets by some of them.
BY_SOME_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"
#: Off, the parts of a union keep tasks of their own although they lie in the same buckets.
ALIKE_TOGETHER = "spark.sql.unionOutputPartitioning"
#: Copies of a row are repeated in arrays of this length.
STRETCH = 10_000
#: Copies of one row that go through a merge as one counted row, and are written by tasks of about ``AT_ONCE`` copies.
HEAVY = 100_000
AT_ONCE = 1_000_000
#: Rows of both sides that a task of a bucketed merge meets, unless a bucket of one partition holds more.
MET_AT_ONCE = 500_000


def _same_key(left: str, right: str, keys: list[str], null_safe: bool) -> Column:
    pairs = [(F.col(f"{left}.{k}"), F.col(f"{right}.{k}")) for k in keys]
    return reduce(and_, [a.eqNullSafe(b) if null_safe else a == b for a, b in pairs])


def held_keys(target: DataFrame, keys: list[str], null_safe: bool = False) -> DataFrame:
    """The distinct keys of the target, stored below the shared folder.

    Copies are combined before the shuffle, so a key the target holds very often is one row here.
    Being stored, the keys meet the source in a join of two plain shuffles, of which adaptive
    execution splits a key that the source has very often over several tasks.
    """
    rows = target.select(*keys)
    if not null_safe:  # a NULL never equals anything
        rows = rows.dropna()
    place = f"{work_folder(target.sparkSession, 'held-keys')}/keys"
    rows.distinct().write.parquet(place)
    return target.sparkSession.read.schema(rows.schema).parquet(place)


def without_partner(source: DataFrame, held: DataFrame, keys: list[str], null_safe: bool = False) -> DataFrame:
    """Source rows whose key is not among the held ones, as one anti join."""
    return source.alias("s").join(held.alias("t"), _same_key("s", "t", keys, null_safe), "left_anti")


def _values(rows: DataFrame, column: str) -> set[str | None]:
    """Distinct values of a partition column, as text: a few per month of data."""
    return {r[0] for r in rows.select(F.col(column).cast("string")).distinct().collect()}


def new_rows(
    source: DataFrame,
    target: DataFrame,
    keys: list[str],
    null_safe: bool = False,
    prune_on: str | None = None,
    brought: set[str | None] | None = None,
    stored: set[str | None] | None = None,
) -> DataFrame:
    """Source rows whose key the target lacks.

    ``prune_on`` is a partition column that follows from the key. Rows of partitions the target does
    not have yet pass as they are; the others meet the keys of their partitions in an anti join.
    ``brought`` and ``stored`` name the partitions of the two sides, as text, where the caller
    knows them; a source laid out by that column is then read once, and the target's keys once.
    """
    if prune_on is None:
        return without_partner(source, held_keys(target, keys, null_safe), keys, null_safe)
    stored = _values(target, prune_on) if stored is None else stored
    if not stored:
        return source
    brought = _values(source, prune_on) if brought is None else brought
    kind = target.schema[prune_on].dataType
    joined, fresh = brought & stored, brought - stored
    parts = [source.where(_among(prune_on, fresh, kind))] if fresh else []
    if joined:
        inside = _among(prune_on, joined, kind)
        held = held_keys(target.where(inside), keys, null_safe)
        parts.append(without_partner(source.where(inside), held, keys, null_safe))
    return reduce(DataFrame.unionByName, parts) if parts else source.limit(0)


def _among(column: str, values: set[str | None], kind) -> Column:
    known = F.col(column).isin([F.lit(v).cast(kind) for v in sorted(v for v in values if v is not None)])
    if None in values:
        return F.col(column).isNull() | known
    return known


def lacking_copies(
    source: DataFrame,
    target: DataFrame | None,
    keys: list[str],
    resume: bool = False,
    null_safe: bool = False,
    buckets: tuple[int, list[str]] | None = None,
) -> DataFrame:
    """Source rows whose key the target lacks, or, to ``resume`` a broken append, as many copies of each source row as the target
    lacks: rows that are equal in all columns are then one kind of row, of which both sides are counted.

    Both sides are combined before they meet, so a row that either holds very often is one row in the join. ``buckets`` (their
    number and columns, some of the keys) are those of the target, which is then met where it lies and not shuffled; it takes
    ``BY_SOME_KEYS`` off. The result lies in these buckets. A NULL key meets nothing unless ``null_safe``, so its rows
    all come again. ``target`` is None where nothing is stored.
    """
    count, held = "copies of the row", "copies held"
    rows = source.groupBy(*source.columns).agg(F.count("*").alias(count))
    if target is None:
        met = rows.repartition(buckets[0], *buckets[1]) if buckets else rows
    else:
        stored = target.select(*keys)
        if not null_safe:
            stored = stored.dropna()
        stored = stored.groupBy(*keys).agg(F.count("*").alias(held))
        stored = stored.hint("merge") if buckets else stored  # a broadcast would leave the source out of the buckets
        met = rows.alias("s").join(stored.alias("t"), _same_key("s", "t", keys, null_safe), "left")
        there = F.coalesce(F.col(held), F.lit(0))
        missing = F.col(count) - there if resume else F.when(there == 0, F.col(count))
        met = met.select(*[F.col(f"s.{c}") for c in source.columns], missing.alias(count)).where(F.col(count) > 0)
    return _repeated(met, count).select(*source.columns)


def missing_copies(source: DataFrame, target: DataFrame | None, keys: list[str], null_safe: bool = False) -> DataFrame:
    """What ``lacking_copies`` gives to resume where all other columns follow from the key: both sides are counted in one grouping by it.

    Each side is combined and shuffled once. A join would shuffle both again: it takes keys of floating point in a form of its own.
    """
    count, held = "copies of the row", "copies held"
    follow = [c for c in source.columns if c not in keys]
    sides = source.withColumns({count: F.lit(1), held: F.lit(0)})
    if target is not None:
        stored = target if null_safe else target.dropna(subset=keys)
        unknown = [F.lit(None).cast(source.schema[c].dataType).alias(c) for c in follow]
        sides = sides.unionByName(stored.select(*keys, *unknown, F.lit(0).alias(count), F.lit(1).alias(held)))
    counted = sides.groupBy(*keys).agg((F.sum(count) - F.sum(held)).alias(count), *[F.max(c).alias(c) for c in follow])
    return _repeated(counted.where(F.col(count) > 0), count).select(*source.columns)


def _repeated(counted: DataFrame, count: str, tasks: int = 0) -> DataFrame:
    """Each row as often as it counts; by that many tasks, if given, whatever lies in one now."""
    # Repeated in two steps: no array is as long as a row may have copies.
    full = F.floor((F.col(count) - 1) / STRETCH)
    met = counted.withColumn("stretch", F.explode(F.sequence(F.lit(0).cast("long"), full)))
    met = met.repartition(tasks) if tasks else met
    here = F.least(F.col(count) - F.col("stretch") * STRETCH, F.lit(STRETCH)).cast("int")
    return met.withColumn("copy", F.explode(F.array_repeat(F.lit(0), here)))


def _facts(rows: DataFrame, prune_on: str | None) -> tuple[set[str | None], dict[int, int]]:
    """From one pass without a shuffle: the partitions the rows touch and, by hash, the rows of very many copies (of the hundred most
    frequent) with about their number."""
    told = rows.select(
        F.xxhash64(*rows.columns).alias("row"), (F.col(prune_on) if prune_on else F.lit(None)).cast("string").alias("part")
    ).agg(
        F.expr("approx_top_k(row, 100, 10000)").alias("often"),
        F.collect_set("part").alias("parts"),
        F.bool_or(F.col("part").isNull()).alias("apart"),
    ).first()
    brought = set(told.parts) | ({None} if told.apart else set())
    return brought, {r["item"]: r["count"] for r in told.often or [] if r["count"] >= HEAVY}


def _heavy_copies(
    rows: DataFrame, heavy: dict[int, int], target: DataFrame | None, keys: list[str], resume: bool, null_safe: bool
) -> DataFrame:
    """What ``lacking_copies`` gives for the rows of these hashes. They are few different ones, so the target's keys are only looked up.

    Sizes in bytes do not show equal rows, which shuffle to next to nothing: adaptive execution would leave all of them to one task's sort.
    """
    count, held = "copies of the row", "copies held"
    place = f"{work_folder(rows.sparkSession, 'heavy')}/rows"
    counted = rows.where(F.xxhash64(*rows.columns).isin(list(heavy))).groupBy(*rows.columns).agg(F.count("*").alias(count))
    counted.write.parquet(place)
    counted = rows.sparkSession.read.schema(counted.schema).parquet(place)
    if target is not None:
        same = _same_key("t", "s", keys, null_safe)
        stored = target.select(*keys).alias("t").join(F.broadcast(counted.alias("s")), same, "left_semi")
        stored = stored.groupBy(*keys).agg(F.count("*").alias(held))
        met = counted.alias("s").join(F.broadcast(stored.alias("t")), _same_key("s", "t", keys, null_safe), "left")
        there = F.coalesce(F.col(held), F.lit(0))
        missing = F.col(count) - there if resume else F.when(there == 0, F.col(count))
        counted = met.select(*[F.col(f"s.{c}") for c in rows.columns], missing.alias(count)).where(F.col(count) > 0)
    return _repeated(counted, count, -(-sum(heavy.values()) // AT_ONCE)).select(*rows.columns)


def _arranged(rows: DataFrame, heavy: DataFrame | None, layout: tuple[tuple[str, ...], tuple[str, ...]]) -> DataFrame:
    """``arrange`` of both; the heavy rows keep their tasks."""
    if heavy is None or not layout[0]:
        return arrange(rows if heavy is None else rows.unionByName(heavy), *layout)
    return gather(rows, *layout[0]).unionByName(heavy).sortWithinPartitions(*layout[0], *layout[1])


@contextmanager
def laid_alike(rows: DataFrame, table: str, prune_on: str, buckets: tuple[int, list[str]]) -> Iterator[DataFrame]:
    """The rows stored below the shared folder, with the partitions and buckets of the table; their catalog entry goes at the end."""
    spark = rows.sparkSession
    name = f"{table}__run_{uuid.uuid4().hex[:12]}"  # named like a run, so that ``sweep`` finds the entry of a lost driver
    place = f"{work_folder(spark, 'batch')}/rows"
    create_table(spark, name, rows.schema, (prune_on,), "rows of a batch", place, bucket_by=tuple(buckets[1]), buckets=buckets[0])
    try:
        append(_gathered(rows, prune_on, buckets), name)
        yield spark.table(name).select(*rows.columns)
    finally:
        spark.sql("DROP TABLE IF EXISTS IDENTIFIER(:name)", {"name": name})


def _gathered(rows: DataFrame, prune_on: str, buckets: tuple[int, list[str]]) -> DataFrame:
    """Few files per partition and bucket; as many tasks as the rows need, not as there are buckets."""
    cut = rows.withColumn("cut", F.pmod(F.hash(*buckets[1]), F.lit(buckets[0])))
    return gather(cut, prune_on, "cut").drop("cut")


def _steps(sides: list[DataFrame], column: str, most: int) -> list[set[str | None]]:
    """The partitions in groups of about ``most`` rows of all sides together."""
    each = reduce(DataFrame.unionAll, [side.select(F.col(column).cast("string").alias("value")) for side in sides])
    steps, held = [], most
    for value, size in sorted(each.groupBy("value").count().collect(), key=lambda r: (r[0] is None, r[0])):
        if held + size > most:
            steps.append(set())
            held = 0
        steps[-1].add(value)
        held += size
    return steps


def lacking_by_steps(
    batch: DataFrame, target: DataFrame, keys: list[str], resume: bool, prune_on: str, buckets: tuple[int, list[str]]
) -> DataFrame:
    """``lacking_copies`` of a batch that is laid out like the target.

    A bucketed scan has one task per bucket, however many partitions it reads. Groups of partitions therefore meet in joins
    of their own, none of which shuffles anything: with ``ALIKE_TOGETHER`` off, tasks grow in number with the rows, not in size.
    """
    kind = target.schema[prune_on].dataType
    found = []
    for step in _steps([batch, target], prune_on, MET_AT_ONCE * buckets[0]):
        inside = _among(prune_on, step, kind)
        found.append(lacking_copies(batch.where(inside), target.where(inside), keys, resume, buckets=buckets))
    return reduce(DataFrame.unionByName, found) if found else batch


def _merge_bucketed(rows, heavy, table, target, keys, prune_on, brought, stored, resume, buckets, write) -> object:
    """Rows of partitions that the target lacks pass as they are; the others are stored in its layout and meet it by steps."""
    kind = target.schema[prune_on].dataType
    fresh, joined = brought - stored, brought & stored
    parts = [] if heavy is None else [heavy]
    if fresh or not joined:
        new = rows.where(_among(prune_on, fresh, kind)) if stored else rows
        parts.append(_gathered(new, prune_on, buckets))
    if not joined:
        return write(reduce(DataFrame.unionByName, parts), table)
    inside = _among(prune_on, joined, kind)
    with laid_alike(rows.where(inside), table, prune_on, buckets) as batch:
        parts.append(lacking_by_steps(batch, target.where(inside), keys, resume, prune_on, buckets))
        return write(reduce(DataFrame.unionByName, parts), table)


def _aligned(source: DataFrame, target: DataFrame) -> DataFrame:
    """Target columns in target types; a column the source lacks is NULL."""
    have = set(source.columns)
    surplus = sorted(have - set(target.columns))
    if surplus:
        raise ValueError(f"the target has no columns {surplus}: merge with evolve=True")
    return source.select(
        [
            (F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in target.schema
        ]
    )


def add_new_columns(spark: SparkSession, source: DataFrame, table: str) -> list[str]:
    """Extend the table by columns only the source has; older rows read NULL there."""
    known = set(spark.table(table).columns)
    new = [f for f in source.schema if f.name not in known]
    if new:
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in new)
        spark.sql(f"ALTER TABLE IDENTIFIER(:name) ADD COLUMNS ({columns})", {"name": table})
    return [f.name for f in new]


def insert_only_merge(
    source: DataFrame,
    table: str,
    keys: list[str],
    null_safe: bool = False,
    dedupe_source: bool = False,
    evolve: bool = False,
    prune_on: str | None = None,
    layout: tuple[tuple[str, ...], tuple[str, ...]] = ((), ()),
    brought: set[str | None] | None = None,
    resume: bool = False,
    write: Callable[[DataFrame, str], object] = append,
) -> object:
    """Append to ``table`` the source rows whose key it does not hold.

    A table bucketed by some of the keys is met where it lies: only the source is shuffled, to the table's buckets. With ``prune_on``
    it is stored in them first, and groups of partitions meet one another, see ``lacking_by_steps``. Rows that the source has
    very often are counted apart and written by tasks of their own. ``resume`` repeats a batch whose append broke: of each row as many copies
    are added as are missing. That needs all columns in the key, but for ``prune_on``. ``write`` takes the new rows and the table; its result is returned.

    ``prune_on`` names a partition column that follows from the key: only partitions
    the batch touches are then read. ``brought`` lists the batch's partitions if they are known, a
    superset will do. ``layout`` gives partition and sort columns for the written files.
    """
    spark = source.sparkSession
    if evolve:
        add_new_columns(spark, source, table)
    target = spark.table(table)
    rows = _aligned(source, target)
    by = bucket_columns(spark, table)
    bucketed = bool(by) and set(by) <= set(keys) and not null_safe
    if resume and set(rows.columns) - {prune_on, n.RUN} != set(keys):
        raise ValueError("to resume, the key must be all columns")
    heavy, copies = {}, None
    if dedupe_source and (resume or bucketed):
        rows = rows.dropDuplicates()
    elif not dedupe_source and "map<" not in rows.schema.simpleString():  # maps can't be compared
        found, heavy = _facts(rows, prune_on)
        brought = found if brought is None else brought
    stored = partition_values(spark, table, prune_on) if prune_on else set()
    if prune_on and brought is None and (stored or resume or bucketed):
        brought = _values(rows, prune_on)
    joined = brought & stored if prune_on and brought else set()
    within = target.where(_among(prune_on, joined, target.schema[prune_on].dataType)) if joined else None if prune_on else target
    if heavy:
        copies = _heavy_copies(rows, heavy, within, keys, resume, null_safe)
        rows = rows.where(~F.xxhash64(*rows.columns).isin(list(heavy)))
    if resume or bucketed:
        buckets = (bucket_count(spark, table), by) if bucketed else None
        with setting(spark, BY_SOME_KEYS, "false"), setting(spark, ALIKE_TOGETHER, "false"):
            if bucketed and prune_on:
                return _merge_bucketed(rows, copies, table, target, keys, prune_on, brought, stored, resume, buckets, write)
            if resume and not bucketed:
                rows = missing_copies(rows, within, keys, null_safe)
            else:
                rows = lacking_copies(rows, within, keys, resume, null_safe, buckets)
            if bucketed:
                return write(rows if copies is None else rows.unionByName(copies), table)
            return write(_arranged(rows, copies, layout), table)
    if prune_on:
        rows = new_rows(rows, target, keys, null_safe, prune_on, brought, stored)
    elif not target.isEmpty():
        rows = new_rows(rows, target, keys, null_safe)
    if dedupe_source:
        rows = rows.dropDuplicates()
    return write(_arranged(rows, copies, layout), table)
