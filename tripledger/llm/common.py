"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tripledger.session import setting, work_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that go to a Python worker at once: with whole texts in them, Spark's own ten thousand take much room on both sides.
BATCH_ROWS = "1000"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Sets ``BATCH_ROWS`` for the session, unless it has fewer: for operators whose caller runs the Python workers."""
    if int(spark.conf.get(_BATCH)) not in range(1, int(BATCH_ROWS) + 1):
        spark.conf.set(_BATCH, BATCH_ROWS)


def stored(rows: DataFrame, purpose: str, codec: str | None = None) -> DataFrame:
    """The rows written below ``spark.checkpoint.dir`` and read again.

    Cuts the lineage in a place every executor sees, so a lost executor costs no earlier work. ``codec``: the files'
    compression, where the session's is not wanted.
    """
    place = f"{work_folder(rows.sparkSession, purpose)}/rows"
    with setting(rows.sparkSession, _BATCH, BATCH_ROWS):
        rows.write.parquet(place, compression=codec)
    return rows.sparkSession.read.schema(rows.schema).parquet(place)


def discard(rows: DataFrame) -> None:
    """Removes the files of a table that ``stored`` wrote, once all that was made of it is stored in its turn."""
    context = rows.sparkSession.sparkContext
    for file in rows.inputFiles()[:1]:
        folder = context._jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def ranked(rows: DataFrame, group: list[str], order: list[str | Column], keep: list[str | Column], into: str = "rank") -> DataFrame:
    """The ``keep`` columns of the rows and each row's place, from 0, in its group by ``order``.

    No group is brought together: the rows are dealt by range of (group, order), so a group of any size is spread
    over as many tasks as it fills, and a place is that within the part plus what the parts before hold. Rows that
    are equal in group and order are placed one way or the other. ``rows`` must be read from files, so that a part
    computed again is the same; ``group`` must be among ``keep`` and not null.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in (*group, *order)]
    tie = fresh_name(rows.columns, "tie")  # equal rows too are spread
    rows = rows.withColumn(tie, F.monotonically_increasing_id())
    rows = rows.repartitionByRange(*keys, tie).sortWithinPartitions(*keys, tie)
    rows = stored(rows.select(*keep, F.monotonically_increasing_id().alias("seq")), "in-order")
    rows = rows.withColumn("part", F.shiftright("seq", 33))
    # A row for each part of a group; Spark itself decides by their size how they meet the rows.
    parts = rows.groupBy(*group, "part").agg(F.count("*").alias("c"), F.min("seq").alias("first"))
    before = Window.partitionBy(*(group or [F.lit(0)])).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("c", F.coalesce(F.sum("c").over(before), F.lit(0)))
    parts = stored(parts.select(*group, "part", (F.col("c") - F.col("first")).alias("shift")), "parts")
    return rows.join(parts, [*group, "part"]).withColumn(into, F.col("seq") + F.col("shift")).drop("seq", "shift")


def is_sound(vector: Column) -> Column:
    """Whether an array holds components, and none that is null or not finite; never null."""
    return (F.size(vector) > 0) & F.coalesce(
        F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False)
    )


_memories: dict[str, Callable[[], None]] = {}


def sole_memory(owner: str, clear: Callable[[], None] = lambda: None) -> None:
    """For a task that begins: what tasks of other operators left in this worker's memory goes. Workers outlive tasks; an
    operator that keeps something for its next task says by ``clear`` how to drop it."""
    for name in [n for n in _memories if n != owner]:
        _memories.pop(name)()
    _memories[owner] = clear


def at_rest() -> None:
    """For a task that ends: what this worker's allocators keep for later goes back to the system, so that workers waiting for
    their next task leave the executor's memory to others."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's; others give back by themselves
    if trim is not None:
        trim(0)


def fresh_name(columns: Iterable[str], wish: str) -> str:
    """A column name that clashes with none of ``columns``, however they are written."""
    taken = {c.lower() for c in columns}
    return wish if wish.lower() not in taken else f"{wish}_{uuid.uuid4().hex[:8]}"


def is_held_out(doc_id: Column) -> Column:
    """Whether the row is one the classifiers never learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def texts_of(values) -> list[str]:
    """A pandas column of texts as a list; a missing text is empty."""
    return [v if isinstance(v, str) else "" for v in values.tolist()]


def as_text(column: str) -> Column:
    """A whole-number column as text: pandas would turn one with nulls into floating-point numbers."""
    return F.col(f"`{column}`").cast("long").cast("string").alias(column)


def numbers_of(values) -> list[int | None]:
    """A pandas column made by ``as_text`` as numbers."""
    return [int(v) if isinstance(v, str) else None for v in values.tolist()]


def utf8(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


_SHIFT = np.uint64(33)
_MIX_A = np.uint64(0xFF51AFD7ED558CCD)
_MIX_B = np.uint64(0xC4CEB9FE1A85EC53)


def mix64(values: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the public murmur3 finalizer)."""
    values = (values ^ (values >> _SHIFT)) * _MIX_A
    values = (values ^ (values >> _SHIFT)) * _MIX_B
    return values ^ (values >> _SHIFT)
