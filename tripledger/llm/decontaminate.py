"""Benchmark decontamination: scan training texts for word windows of test items.

An item's text is lower-cased (A-Z) and cut into words of digits, a-z and characters beyond ASCII.
Its windows are all runs of ``width`` consecutive words, or the whole item if it has fewer. The
windows' hashes, bounded in bytes, go to the executors as a broadcast; each task slides over the
words of its documents, looks hashes up in vectorised steps and compares the words of every hit, so
a hash collision is never reported. A benchmark larger than the bound is scanned in several passes,
each over a part of its windows, and the passes are joined per document.

Defined results: a missing or wordless text has no words and no hits; a missing or wordless item,
or one without ``item_id``, takes no part; repeated items count once per id; repeated documents are
each judged; other columns of either table are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripledger.llm.common import at_rest, fresh_name, small_batches, sole_memory, stored, texts_of, utf8
from tripledger.llm.tokens import in_steps

WIDTH = 10
#: Bytes of window text that one broadcast may hold.
BROADCAST_BYTES = 32 << 20
#: Characters of the texts whose words are joined into one array per vectorised step.
STEP_CHARS = 1_000_000

_KEPT = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(0x80, 0x100))
_FOLD = bytes(
    b if b in _KEPT else (b + 32 if 65 <= b <= 90 else 32) for b in range(256)
)
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)

SCANNED = (
    "n_words long, starts array<int>, ends array<int>, cuts array<int>, items array<string>"
)


def words_of(text: str) -> list[bytes]:
    """The normalised words; bytes of one UTF-8 character stay together."""
    return utf8(text).translate(_FOLD).split()


@dataclass
class Windows:
    """A part of the benchmark: hashes to search, and what each hash stands for."""

    vocabulary: dict[bytes, int]
    by_length: dict[int, np.ndarray]
    content: dict[tuple[int, ...], list[str]]

    @classmethod
    def of(cls, rows: list[tuple[str, list[str]]]) -> Windows:
        vocabulary: dict[bytes, int] = {}
        content: dict[tuple[int, ...], list[str]] = {}
        for window, items in rows:
            ids = tuple(vocabulary.setdefault(w, len(vocabulary) + 1) for w in utf8(window).split(b" "))
            content[ids] = items
        lengths: dict[int, list[tuple[int, ...]]] = {}
        for ids in content:
            lengths.setdefault(len(ids), []).append(ids)
        hashed = {n: np.unique(rolling(np.array(x, np.uint64).ravel(), n)[::n]) for n, x in lengths.items()}
        return cls(vocabulary, hashed, content)


def rolling(ids: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of every run of ``width`` ids."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    hashed = np.zeros(n, np.uint64)
    for k in range(width):
        hashed = (hashed + ids[k : k + n]) * _BASE
    return hashed


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted, with overlapping and touching spans joined."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _char_spans(text: str, spans: list[tuple[int, int]]) -> list[int]:
    """Word spans as character offsets: start, end, start, end, ..."""
    places = [m.span() for m in _WORD.finditer(text)]
    return [x for a, b in spans for x in (places[a][0], places[b - 1][1])]


def scan(texts: list[str], windows: Windows) -> Iterator[tuple]:
    """For each text: word count, hit word spans, the same as character offsets, item ids."""
    get = windows.vocabulary.get
    for begin, end in in_steps(texts, STEP_CHARS):
        step = [words_of(t) for t in texts[begin:end]]
        total = sum(map(len, step)) + len(step)
        ids = np.zeros(total, np.uint64)  # a zero ends each text, so no window crosses it
        ends = np.cumsum([len(w) + 1 for w in step])
        starts = ends - [len(w) + 1 for w in step]
        for a, w in zip(starts, step, strict=True):
            ids[a : a + len(w)] = [get(x, 0) for x in w]
        known = np.concatenate(([0], np.cumsum(ids == 0)))
        found: dict[int, tuple[list, set]] = {}
        for width, wanted in windows.by_length.items():
            if total < width:
                continue
            whole = np.flatnonzero(known[width:] == known[:-width])
            if not len(whole):
                continue
            hashed = rolling(ids, width)[whole]
            at = np.minimum(np.searchsorted(wanted, hashed), len(wanted) - 1)
            for p in whole[wanted[at] == hashed]:
                items = windows.content.get(tuple(ids[p : p + width].tolist()))
                if items is not None:
                    d = int(np.searchsorted(ends, p, side="right"))
                    spans, names = found.setdefault(d, ([], set()))
                    spans.append((int(p - starts[d]), int(p - starts[d]) + width))
                    names.update(items)
        for d, w in enumerate(step):
            spans, names = found.get(d, ([], set()))
            spans = _merged(spans)
            cuts = _char_spans(texts[begin + d], spans) if spans else []
            yield len(w), [a for a, _ in spans], [b for _, b in spans], cuts, sorted(names)


def item_windows(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """``window`` (words with single blanks) and the sorted ``items`` that contain it."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for item, text in zip(batch["item"], texts_of(batch["text"]), strict=True):
                words = [w.decode("utf-8", "surrogatepass") for w in words_of(text)]
                last = max(len(words) - width, 0) if words else -1
                out += [(" ".join(words[k : k + width]), item) for k in range(last + 1)]
            yield pd.DataFrame(out, columns=["window", "item"], dtype=object)

    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))
    items = items.where("item is not null and text is not null")
    return (
        items.mapInPandas(cut, "window string, item string")
        .groupBy("window")
        .agg(F.sort_array(F.collect_set("item")).alias("items"))
    )


def _scanner(spark, rows: list[tuple[str, list[str]]]):
    """A column function over texts for one broadcast part of the benchmark."""
    shared = spark.sparkContext.broadcast(rows)

    @F.pandas_udf(SCANNED)
    def scanned(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        sole_memory("windows")
        windows = Windows.of(shared.value)
        for texts in batches:
            yield pd.DataFrame(
                list(scan(texts_of(texts), windows)), columns=["n_words", "starts", "ends", "cuts", "items"]
            )
        del windows
        at_rest()

    return scanned


def scanned(
    docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, text: str = "text", into: str = "found",
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``docs`` with a struct ``into``: ``n_words`` and the hits (see ``SCANNED``). Sets ``common.small_batches`` for the session."""
    spark = docs.sparkSession
    small_batches(spark)
    windows = stored(item_windows(benchmark, width), "windows")
    weight = F.octet_length("window") + F.aggregate("items", F.lit(0), lambda a, x: a + F.octet_length(x) + 8) + 64
    size = windows.agg(F.sum(weight.cast("long"))).first()[0] or 0
    parts = max(1, -(-size // broadcast_bytes))

    def part(k: int) -> list[tuple[str, list[str]]]:
        some = windows.where(F.pmod(F.xxhash64("window"), F.lit(parts)) == k) if parts > 1 else windows
        return [(r[0], r[1]) for r in some.collect()]

    body = F.col(f"`{text}`").cast("string")
    if parts == 1:
        return docs.withColumn(into, _scanner(spark, part(0))(body))
    # Passes: rows get a number that stays, each pass leaves rows only for documents that it hits.
    row, parts_of = fresh_name(docs.columns, "row"), fresh_name(docs.columns, "parts")
    docs = stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    passes = []
    for k in range(parts):
        some = docs.select(row, _scanner(spark, part(k))(body).alias("f"))
        passes.append(stored(some.select(row, "f.*").where("size(items) > 0"), "pass"))
    hits = passes[0]
    for more in passes[1:]:
        hits = hits.unionByName(more)
    hits = stored(hits.groupBy(row).agg(F.collect_list(F.struct("starts", "ends", "items")).alias(parts_of)), "hits")

    @F.pandas_udf(SCANNED)
    def joined(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, found in batches:
            out = []
            for t, some in zip(texts_of(texts), found, strict=True):
                some = [] if some is None else some
                spans = _merged([(int(a), int(b)) for p in some for a, b in zip(p["starts"], p["ends"], strict=True)])
                names = sorted({i for p in some for i in p["items"]})
                cuts = _char_spans(t, spans) if spans else []
                out.append((len(words_of(t)), [a for a, _ in spans], [b for _, b in spans], cuts, names))
            yield pd.DataFrame(out, columns=["n_words", "starts", "ends", "cuts", "items"])

    both = docs.join(hits, row, "left")
    return both.withColumn(into, joined(body, F.col(parts_of))).drop(row, parts_of)


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, remove: str = "documents", width: int = WIDTH, text: str = "text"
) -> DataFrame:
    """``docs`` without the benchmark's passages, in the columns they came with.

    ``remove="documents"`` drops every document with a hit; ``"spans"`` cuts the hit words, with
    what stands between them, out of the text and keeps the document.
    """
    columns = docs.columns
    into = fresh_name(columns, "found")
    found = scanned(docs, benchmark, width, text, into)
    if remove == "documents":
        return found.where(F.size(f"{into}.items") == 0).select(*[f"`{c}`" for c in columns])
    if remove != "spans":
        raise ValueError(f"remove: documents or spans, not {remove}")
    cuts, body = F.col(f"{into}.cuts"), F.col(f"`{text}`")
    edges = F.concat(F.array(F.lit(0)), cuts, F.array(F.length(body)))
    kept = F.transform(
        F.sequence(F.lit(0), F.size(cuts), F.lit(2)),
        lambda k: F.substring(body, F.get(edges, k) + 1, F.get(edges, k + 1) - F.get(edges, k)),
    )
    cleaned = F.when(F.size(cuts) > 0, F.concat_ws("", kept)).otherwise(body)
    return found.withColumn(text, cleaned).select(*[f"`{c}`" for c in columns])


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def report(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """Per document: words, hit words, items whose windows occur, and whether any does."""
    found = scanned(docs.select("doc_id", "text"), benchmark, width)
    n_hit = F.aggregate(
        F.arrays_zip("found.starts", "found.ends"), F.lit(0), lambda n, s: n + s["ends"] - s["starts"]
    )
    return found.select(
        "doc_id",
        "found.n_words",
        n_hit.cast("long").alias("n_hit"),
        F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "found.items"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )
