"""Token-id files: one array of ids, with Elias-Fano coded document boundaries.

A shard file holds, one after the other:

* a fixed head: magic, width of an id in bytes;
* the ids of all documents of the shard, concatenated (2 bytes each where the vocabulary allows it);
* the documents' end positions, Elias-Fano coded: of each value the low bits in a packed array and
  the high part as a unary bit vector, about ``2 + log2(ids / documents)`` bits a document, with one
  32-bit sample for every ``SAMPLE`` documents from which ``select`` reaches a document without a
  table of 64-bit offsets;
* the documents' keys, ascending, coded in the same way;
* a JSON foot with the sections' places, and its length.

Files are written by the tasks below the shared folder, under a name of the attempt; the rows a task
returns name the finished file. A lost attempt's file is named by no row and never read.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripledger.llm.common import discard, stored, texts_of
from tripledger.llm.tokens import Encoder, in_steps
from tripledger.session import work_folder

MAGIC = b"TLIDS\x01"
HEAD = 16
SAMPLE = 256
#: Documents whose ids are read in one step.
STEP_DOCS = 2048
STEP_IDS = 4 << 20
#: Bytes of ids in a file.
SHARD_BYTES = 32 << 20


# ---------------------------------------------------------------- Elias-Fano


@dataclass
class Monotone:
    """A non-decreasing sequence of integers >= 0 in Elias-Fano form."""

    n: int
    low_bits: int
    low: np.ndarray  # packed low parts, uint8
    high: np.ndarray  # unary high parts, uint8
    samples: np.ndarray  # position of every SAMPLE-th one in ``high``, uint32 (relative to its block)
    bases: np.ndarray  # one 64-bit base per 65,536 samples

    @classmethod
    def encode(cls, values: np.ndarray) -> Monotone:
        values = np.asarray(values, np.uint64)
        n = len(values)
        universe = int(values[-1]) + 1 if n else 0
        bits = max(0, (universe // n).bit_length() - 1) if n else 0
        low = np.zeros((n, bits), np.uint8)
        for k in range(bits):
            low[:, k] = (values >> np.uint64(k)) & np.uint64(1)
        ones = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        high[ones] = 1
        sampled = ones[::SAMPLE]
        bases = sampled[:: 1 << 16].astype(np.int64)
        relative = sampled - np.repeat(bases, 1 << 16)[: len(sampled)]
        if len(relative) and relative.max() >= 1 << 32:
            raise ValueError("a shard this sparse needs fewer documents per block")
        return cls(
            n, bits, np.packbits(low.ravel(), bitorder="little"), np.packbits(high, bitorder="little"),
            relative.astype(np.uint32), bases,
        )

    def size(self) -> int:
        return sum(x.nbytes for x in (self.low, self.high, self.samples, self.bases))

    def _lows(self, begin: int, end: int) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(end - begin, np.uint64)
        a, b = begin * self.low_bits, end * self.low_bits
        bits = np.unpackbits(self.low[a // 8 : -(-b // 8)], bitorder="little")[a % 8 :][: b - a]
        weights = np.uint64(1) << np.arange(self.low_bits, dtype=np.uint64)
        return bits.reshape(end - begin, self.low_bits).astype(np.uint64) @ weights

    def slice(self, begin: int, end: int) -> np.ndarray:
        """Values ``begin`` to ``end``: select on the bit vector from the nearest sample on."""
        end = min(end, self.n)
        if begin >= end:
            return np.empty(0, np.uint64)
        first = begin // SAMPLE
        position = int(self.bases[first >> 16]) + int(self.samples[first])
        at = position // 8
        skip, found, total = first * SAMPLE, [], 0
        need = end - skip
        while total < need:
            stretch = max(64, (need - total) // 2)
            bits = np.unpackbits(self.high[at : at + stretch], bitorder="little")
            ones = np.flatnonzero(bits) + at * 8
            ones = ones[ones >= position]
            found.append(ones)
            total += len(ones)
            at += stretch
        ones = np.concatenate(found)[begin - skip : need]
        high = (ones - np.arange(begin, end)).astype(np.uint64)
        return (high << np.uint64(self.low_bits)) | self._lows(begin, end)

    def select(self, k: int) -> int:
        """Value number ``k``."""
        if not 0 <= k < self.n:
            raise IndexError(k)
        return int(self.slice(k, k + 1)[0])

    def write(self, out) -> dict:
        about = {"n": self.n, "low_bits": self.low_bits}
        for name in ("low", "high", "samples", "bases"):
            data = getattr(self, name)
            about[name] = [out.tell(), len(data)]
            out.write(data.tobytes())
        return about

    @classmethod
    def read(cls, source, about: dict) -> Monotone:
        def part(name: str, kind) -> np.ndarray:
            at, count = about[name]
            source.seek(at)
            return np.frombuffer(source.read(count * np.dtype(kind).itemsize), kind)

        return cls(
            about["n"], about["low_bits"], part("low", np.uint8), part("high", np.uint8),
            part("samples", "<u4"), part("bases", "<i8"),
        )


# ---------------------------------------------------------------- shard files


def _open(url: str, write: bool = False):
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(url)
    return system.open_output_stream(path, compression=None) if write else system.open_input_file(path)


class ShardWriter:
    def __init__(self, url: str, width: int):
        self.url, self.width, self.out = url, width, _open(url, write=True)
        self.out.write((MAGIC + bytes([width])).ljust(HEAD, b"\0"))
        self.lengths: list[int] = []
        self.keys: list[int] = []

    def add(self, keys: list[int], packed: list[bytes]) -> None:
        """Documents by their ids, little-endian and of the file's width."""
        self.out.write(b"".join(packed))
        self.lengths += [len(x) // self.width for x in packed]
        self.keys += keys

    def close(self) -> tuple[int, int]:
        """Number of documents and of ids."""
        ends = np.cumsum(np.array(self.lengths, np.int64))
        first = self.keys[0] if self.keys else 0
        keys = np.array([k - first for k in self.keys], np.uint64)
        foot = {"ends": Monotone.encode(ends).write(self.out), "keys": Monotone.encode(keys).write(self.out)}
        raw = json.dumps(foot | {"first_key": first}).encode()
        self.out.write(raw + len(raw).to_bytes(8, "little"))
        self.out.close()
        return len(ends), int(ends[-1]) if len(ends) else 0


class Shard:
    """Random access to the documents of one file."""

    def __init__(self, url: str):
        self.source = _open(url)
        size = self.source.size()
        head = self.source.read(HEAD)
        if head[: len(MAGIC)] != MAGIC:
            raise ValueError(f"not a token-id file: {url}")
        self.width = head[len(MAGIC)]
        self.source.seek(size - 8)
        length = int.from_bytes(self.source.read(8), "little")
        self.source.seek(size - 8 - length)
        foot = json.loads(self.source.read(length))
        self.ends = Monotone.read(self.source, foot["ends"])
        self.keys = Monotone.read(self.source, foot["keys"])
        self.first_key = foot["first_key"]

    def __len__(self) -> int:
        return self.ends.n

    def ids(self, start: int, end: int) -> np.ndarray:
        self.source.seek(HEAD + start * self.width)
        return np.frombuffer(self.source.read((end - start) * self.width), f"<u{self.width}")

    def document(self, k: int) -> np.ndarray:
        return self.ids(self.ends.select(k - 1) if k else 0, self.ends.select(k))

    def documents(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """(key, start, ids) of all documents, reading a bounded stretch of ids at a time."""
        for begin in range(0, len(self), STEP_DOCS):
            ends = self.ends.slice(begin, begin + STEP_DOCS).astype(np.int64)
            keys = self.keys.slice(begin, begin + STEP_DOCS)
            starts = np.concatenate(([self.ends.select(begin - 1) if begin else 0], ends[:-1]))
            a = 0
            while a < len(ends):
                b = max(a + 1, int(np.searchsorted(ends, starts[a] + STEP_IDS, side="right")))
                block = self.ids(int(starts[a]), int(ends[b - 1]))
                for k in range(a, b):
                    yield (
                        int(keys[k]) + self.first_key, int(starts[k]),
                        block[starts[k] - starts[a] : ends[k] - starts[a]],
                    )
                a = b


def write(
    docs: DataFrame, path: str, end_id: int = 2, width: int = 2, shards: int | None = None, text: str = "text",
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """Files with the ids of all documents in ascending ``doc_id`` order.

    Gives one row per file: ``url``, ``first_key``, ``last_key``, ``documents``, ``ids``, stored. A null
    text is empty (the end id alone); rows without ``doc_id`` have no place in the order and are left
    out; repeated rows are written as often as they come, whichever files they fall into. Texts are encoded where they are
    read, so that ids and not texts are put in order; a file takes about ``shard_bytes``, unless the number of ``shards`` is
    given. An id that does not fit ``width`` bytes is an error. An empty table gives no files; other columns are not
    looked at.
    """
    folder = work_folder(docs.sparkSession, "ids")

    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder.at(path, width)
        end = encoder.packed([end_id])
        for batch in batches:
            keys, texts = batch["doc_id"].tolist(), texts_of(batch["text"])
            for a, b in in_steps(texts):
                ids = [raw + end for raw in encoder.encode(texts[a:b])]
                yield pd.DataFrame({"doc_id": keys[a:b], "size": [len(x) for x in ids], "ids": ids})

    def written(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        writer = None
        for batch in batches:
            if len(batch):
                writer = writer or ShardWriter(f"{folder}/{uuid.uuid4().hex}.ids", width)
                writer.add(batch["doc_id"].tolist(), batch["ids"].tolist())
        if writer is not None:
            documents, ids = writer.close()
            about = {"url": writer.url, "first_key": writer.keys[0], "last_key": writer.keys[-1], "documents": documents, "ids": ids}
            yield pd.DataFrame([about])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    coded = stored(rows.where("doc_id is not null").mapInPandas(encoded, "doc_id long, size long, ids binary"), "encoded", "zstd")
    total = coded.agg(F.sum("size")).first()[0] or 0
    rows = coded.withColumn("tie", F.monotonically_increasing_id())  # an id that many rows repeat is spread too
    rows = rows.repartitionByRange(shards or max(1, -(-total // shard_bytes)), "doc_id", "tie").sortWithinPartitions("doc_id")
    schema = "url string, first_key long, last_key long, documents long, ids long"
    files = stored(rows.select("doc_id", "ids").mapInPandas(written, schema), "manifest")
    discard(coded)
    return files


def read(files: DataFrame) -> DataFrame:
    """Every document of the files: ``doc_id``, ``start`` (in the whole), ``ids`` digest columns."""

    def decoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for url, begin in zip(batch["url"], batch["begin"], strict=True):
                out = []
                for key, start, ids in Shard(url).documents():
                    out.append((key, int(begin) + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    if len(out) == 50_000:
                        yield pd.DataFrame(out, columns=names)
                        out = []
                if out:
                    yield pd.DataFrame(out, columns=names)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    names = [c.split()[0] for c in schema.split(", ")]
    # One row per file: a running sum over them is small whatever the corpus.
    before = Window.orderBy("first_key", "last_key", "url").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("url", F.coalesce(F.sum("ids").over(before), F.lit(0)).cast("long").alias("begin"))
    files = stored(files, "begins")
    spread = max(1, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return files.repartition(spread, "url").mapInPandas(decoded, schema)
