"""Vector best-fit packing of token sequences, planned on the histogram of piece lengths.

A piece of ``n`` tokens asks for a vector: ``n`` tokens, one document, ``n * n`` attention cost. Bins
have a capacity in each of the three. Pieces go, longest first, into the bin that the rule picks among
those with room in every dimension: the least norm of what remains (``norm``), or the least weighted
dot product of the request with the room left (``dot``), each scaled by the capacities.

Pieces of one length are interchangeable, so the decisions are made for lengths and counts: a plan has
at most a few thousand kinds of bins whatever the number of documents, as each length splits at most
one kind and opens at most two. Each piece then finds its bin by its rank among the pieces of its
length. Ranks are counted in the task that reads the piece and shifted by the counts of the tasks
before it, so no length, however frequent, meets in one task.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tripledger.llm.common import as_text, at_rest, numbers_of, stored, texts_of
from tripledger.llm.tokens import Encoder, in_steps

#: Pieces of text whose ids a worker remembers: twice as many at most, some 200 bytes each.
REMEMBERED = 500_000


@dataclass(frozen=True)
class Capacity:
    """What one sequence holds; ``documents`` counts pieces, ``cost`` sums squared lengths."""

    tokens: int = 2048
    documents: int = 2048
    cost: int = 2048 * 2048
    weights: tuple[float, float, float] = (1.0, 1.0, 1.0)
    rule: str = "norm"

    @property
    def longest(self) -> int:
        """The longest piece that fits a sequence of its own."""
        if min(self.tokens, self.documents, self.cost) < 1:
            raise ValueError("every capacity must be at least 1")
        return min(self.tokens, math.isqrt(self.cost))


def cut(total: int, longest: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones, with a shorter one first if need be."""
    first = total % longest
    edges = ([0] if first else []) + list(range(first, total + 1, longest))
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


PIECES = (
    "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, "
    "part int, place long"
)


def pieces(
    docs: DataFrame, path: str, end_id: int = 0, capacity: Capacity = Capacity(), ids: bool = True,
    text: str = "text", remembered: int = REMEMBERED,
) -> DataFrame:
    """The pieces of all documents, with their ids (little-endian unsigned 32-bit) if asked for.

    ``part`` and ``place`` number the piece among those of its length within the task that made it;
    they hold for these rows only, so the result is written once and read from there.
    """
    longest = capacity.longest

    def tokenised(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder.at(path, remembered=remembered)
        tail = np.array([end_id], "<u4").tobytes()
        part = TaskContext.get().partitionId()
        seen = np.zeros(longest + 1, np.int64)
        for batch in batches:
            keys, texts = numbers_of(batch["doc_id"]), texts_of(batch["text"])
            for a, b in in_steps(texts):
                out = []
                for key, raw in zip(keys[a:b], encoder.encode(texts[a:b]), strict=True):
                    raw += tail
                    for k, (start, length) in enumerate(cut(len(raw) // 4, longest)):
                        some = raw[4 * start : 4 * (start + length)]
                        out.append(
                            (key, k, start, length, zlib.crc32(some), some if ids else None, part, int(seen[length]))
                        )
                        seen[length] += 1
                yield pd.DataFrame(out, columns=[c.split()[0] for c in PIECES.split(", ")], dtype=object)
        at_rest()

    texts = docs.select(as_text("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    made = texts.mapInPandas(tokenised, PIECES)
    return made if ids else made.drop("ids")


@dataclass
class Kind:
    """``count`` equal bins: their pieces' lengths with how often each occurs, and the room left."""

    count: int
    holds: list[tuple[int, int]]


def _request(length: int) -> np.ndarray:
    return np.array([length, 1, length * length], np.int64)


def plan(histogram: dict[int, int], capacity: Capacity) -> list[Kind]:
    """Kinds of bins for the given number of pieces of each length."""
    full = np.array([capacity.tokens, capacity.documents, capacity.cost], np.int64)
    scale = np.array(capacity.weights) / full
    kinds: list[Kind] = []
    room = np.zeros((0, 3), np.int64)

    def add(kind: Kind, left: np.ndarray) -> None:
        nonlocal room
        kinds.append(kind)
        room = np.vstack([room, left[None]])

    def put(k: int, length: int, times: int) -> None:
        """``times`` pieces into each bin of the kind."""
        kinds[k].holds = [*kinds[k].holds, (length, times)]
        room[k] -= _request(length) * times

    for length in sorted(histogram, reverse=True):
        left, request = histogram[length], _request(length)
        while left:
            fits = np.flatnonzero((room >= request).all(axis=1))
            if len(fits):
                # Pieces of one length that go on filling a bin do so at once, as best fit would.
                if capacity.rule == "norm":
                    score = (((room[fits] - request) * scale) ** 2).sum(axis=1)
                elif capacity.rule == "dot":
                    score = (room[fits] * scale * (request * scale)).sum(axis=1)
                else:
                    raise ValueError(f"rule: norm or dot, not {capacity.rule}")
                k = int(fits[np.argmin(score)])
                times = int((room[k] // request).min())
                bins = min(left // times, kinds[k].count)
                if bins == 0:  # fewer than fill one bin
                    times, bins = left, 1
                if bins < kinds[k].count:
                    add(Kind(kinds[k].count - bins, list(kinds[k].holds)), room[k].copy())
                    kinds[k].count = bins
                put(k, length, times)
            else:
                times = int((full // request).min())
                bins = left // times
                if bins == 0:
                    times, bins = left, 1
                add(Kind(bins, [(length, times)]), full - request * times)
            left -= bins * times
    return kinds


def intervals(kinds: list[Kind]) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, end rank, times, first sequence, offset): piece ``r`` of the length,
    counted from the first rank, goes to sequence ``first + r // times`` at
    ``offset + (r % times) * length``."""
    given: dict[int, int] = {}
    rows, first = [], 0
    for kind in kinds:
        offset = 0
        for length, times in kind.holds:
            begin = given.get(length, 0)
            given[length] = begin + kind.count * times
            rows.append((length, begin, given[length], times, first, offset))
            offset += length * times
        first += kind.count
    return rows


def pack(made: DataFrame, capacity: Capacity = Capacity()) -> DataFrame:
    """The pieces (stored rows of ``pieces``) with ``sequence_id`` and ``offset``."""
    spark = made.sparkSession
    counts = stored(made.groupBy("length", "part").agg(F.count("*").alias("n")), "lengths")
    # At most one row per length: bounded by the capacity, not by the corpus.
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}
    rows = intervals(plan(histogram, capacity))
    schema = "length long, rank_from long, rank_to long, times long, first long, shift long"
    places = spark.createDataFrame(pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")], dtype="int64"), schema)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    ranked = made.join(begins, ["length", "part"]).withColumn("rank", F.col("begin") + F.col("place"))
    inside = (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to"))
    found = ranked.alias("p").join(
        F.broadcast(places).alias("b"), (F.col("p.length") == F.col("b.length")) & inside
    )
    nth = F.col("rank") - F.col("rank_from")
    return found.select(
        *[F.col(f"p.{c}") for c in made.columns if c not in ("part", "place")],
        (F.col("first") + F.floor(nth / F.col("times"))).cast("long").alias("sequence_id"),
        (F.col("shift") + nth % F.col("times") * F.col("p.length")).cast("long").alias("offset"),
    )


def packed(
    docs: DataFrame, path: str, end_id: int = 0, capacity: Capacity = Capacity(), ids: bool = False, text: str = "text",
    remembered: int = REMEMBERED,
) -> DataFrame:
    """Every document's pieces, each in its place in a sequence.

    A null text is empty: a piece with the end id alone. Repeated rows are packed as often as they
    come; a null ``doc_id`` stays null. An empty table gives no rows. Other columns are left out.
    """
    return pack(stored(pieces(docs, path, end_id, capacity, ids, text, remembered), "pieces"), capacity)


def sequences(placed: DataFrame) -> DataFrame:
    """The packed sequences themselves: ``sequence_id``, ``length``, ``ids`` (from ``ids=True``)."""
    parts = F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("ids"))))
    joined = F.unhex(F.concat_ws("", F.transform(parts, lambda p: p["ids"])))
    return placed.groupBy("sequence_id").agg(F.sum("length").alias("length"), joined.alias("ids"))


def session_path(spark: SparkSession, name: str) -> str:
    """Where the public vocabulary file lies; it has to be installed on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)
