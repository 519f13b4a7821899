"""Quality classifier: a generalised additive model with pairwise interactions.

A document is described by bounded features of its whole text. Each feature is cut into bins at
quantiles of the training sample. Boosting goes round the features in turn, fits a shallow tree to the
gradient over that feature's bins and adds it, scaled down, to the feature's table; then the pairs
of features with the most left to explain get tables of their own in the same way, over coarser bins.
A score is the sum of one entry per table, so scoring is a few vectorised look-ups.

The fit uses a bounded sample of labelled rows (``Training.sample``, by hash of ``doc_id``) and only
their features reach the driver. Scoring is one pass over all texts without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from tripledger.llm.common import fresh_name, is_held_out, texts_of, utf8


@dataclass(frozen=True)
class Training:
    sample: int = 20_000
    bins: int = 32
    pair_bins: int = 8
    pairs: int = 10
    rounds: int = 120
    pair_rounds: int = 60
    leaves: int = 3
    pair_leaves: int = 4
    rate: float = 0.15
    least: int = 10  # rows in a leaf
    shrink: float = 5.0


# ---------------------------------------------------------------- features

_BYTES = np.arange(256)
_CLASSES = np.stack(
    [
        (_BYTES >= 97) & (_BYTES <= 122),  # a-z
        (_BYTES >= 65) & (_BYTES <= 90),  # A-Z
        (_BYTES >= 48) & (_BYTES <= 57),  # digits
        np.isin(_BYTES, [32, 9, 10, 11, 12, 13]),
        np.isin(_BYTES, list(b".,;:")),
        np.isin(_BYTES, list(b"!?")),
        np.isin(_BYTES, list(b"#$%&*+/<=>@\\^_`{|}~")),
        np.isin(_BYTES, list(b"\"'()-[]")),
        _BYTES >= 128,
        _BYTES == 10,
    ],
    axis=1,
).astype(np.float64)
_LINK = re.compile(rb"https?://|www\.")

FEATURES = [
    "log_bytes", "log_words", "lower", "upper", "digits", "blanks", "stops", "shouts", "symbols", "quotes",
    "beyond_ascii", "line_breaks", "word_length", "word_spread", "distinct_words", "repeated_words",
    "distinct_lines", "line_length", "short_words", "long_words", "links", "ends_in_stop",
]


def features(text: str) -> list[float]:
    """Numbers that do not depend on any other document; an empty text has zeros."""
    raw = utf8(text)
    n = len(raw)
    if not n:
        return [0.0] * len(FEATURES)
    shares = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _CLASSES / n
    words = raw.split()
    count = max(len(words), 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return [
        np.log1p(n), np.log1p(len(words)), *shares.tolist(), lengths.mean(), lengths.std(),
        len(set(words)) / count, sum(map(eq, words, words[1:])) / count,
        len(set(lines)) / max(len(lines), 1), np.log1p(n / max(len(lines), 1)),
        (lengths <= 2).mean(), (lengths >= 15).mean(), len(_LINK.findall(raw)) / count,
        float(raw.rstrip()[-1:] in (b".", b"!", b"?")),
    ]


# ---------------------------------------------------------------- model


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Additive:
    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]  # for pairs: the coarse bin of each bin
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)], axis=1)

    def logit(self, binned: np.ndarray) -> np.ndarray:
        total = np.full(len(binned), self.base)
        for k, table in enumerate(self.tables):
            total += table[binned[:, k]]
        for (a, b), table in self.pairs.items():
            total += table[self.coarse[a][binned[:, a]], self.coarse[b][binned[:, b]]]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return _logistic(self.logit(self.bins(x)))


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, t: Training) -> np.ndarray:
    """Leaf values over ordered bins: best splits first until the tree has its leaves."""
    total_g, total_h, total_n = (np.concatenate(([0.0], np.cumsum(v))) for v in (g, h, n))

    def worth(a: int, b: int) -> float:
        return (total_g[b] - total_g[a]) ** 2 / (total_h[b] - total_h[a] + t.shrink)

    def best(a: int, b: int) -> tuple[float, int]:
        at = np.arange(a + 1, b)
        if not len(at):
            return 0.0, a
        left = (total_g[at] - total_g[a]) ** 2 / (total_h[at] - total_h[a] + t.shrink)
        right = (total_g[b] - total_g[at]) ** 2 / (total_h[b] - total_h[at] + t.shrink)
        enough = (total_n[at] - total_n[a] >= t.least) & (total_n[b] - total_n[at] >= t.least)
        gain = np.where(enough, left + right - worth(a, b), 0.0)
        k = int(np.argmax(gain))
        return float(gain[k]), int(at[k])

    leaves = [(0, len(g))]
    while len(leaves) < t.leaves:
        found = [(*best(a, b), k) for k, (a, b) in enumerate(leaves)]
        gain, at, k = max(found)
        if gain <= 1e-9:
            break
        a, b = leaves.pop(k)
        leaves += [(a, at), (at, b)]
    out = np.zeros(len(g))
    for a, b in leaves:
        out[a:b] = (total_g[b] - total_g[a]) / (total_h[b] - total_h[a] + t.shrink)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, t: Training) -> tuple[np.ndarray, float]:
    """The same over a grid: rectangles, cut along either side; and the gain."""
    out, gained = np.zeros(g.shape), 0.0
    boxes = [(0, g.shape[0], 0, g.shape[1])]

    def best(box: tuple) -> tuple[float, int, int]:
        a, b, c, d = box
        found = (0.0, 0, 0)
        for axis in (0, 1):
            sides = [np.cumsum(v[a:b, c:d].sum(axis=1 - axis)) for v in (g, h, n)]
            if len(sides[0]) < 2:
                continue
            (lg, lh, ln), (tg, th, tn) = ([s[:-1] for s in sides], [s[-1] for s in sides])
            gain = lg**2 / (lh + t.shrink) + (tg - lg) ** 2 / (th - lh + t.shrink) - tg**2 / (th + t.shrink)
            gain = np.where((ln >= t.least) & (tn - ln >= t.least), gain, 0.0)
            k = int(np.argmax(gain))
            found = max(found, (float(gain[k]), axis, k + 1))
        return found

    while len(boxes) < t.pair_leaves:
        (gain, axis, at), k = max((best(b), k) for k, b in enumerate(boxes))
        if gain <= 1e-9:
            break
        a, b, c, d = boxes.pop(k)
        boxes += [(a, a + at, c, d), (a + at, b, c, d)] if axis == 0 else [(a, b, c, c + at), (a, b, c + at, d)]
        gained += gain
    for a, b, c, d in boxes:
        out[a:b, c:d] = g[a:b, c:d].sum() / (h[a:b, c:d].sum() + t.shrink)
    return out, gained


def train(x: np.ndarray, y: np.ndarray, t: Training = Training()) -> Additive:
    """With no rows every score is a half; with one class, close to it."""
    rate = (y.sum() + 0.5) / (len(y) + 1.0)
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, t.bins + 1)[1:-1])) if len(x) else np.empty(0) for k in range(len(FEATURES))]
    widths = [len(e) + 1 for e in edges]
    coarse = [np.arange(w) * t.pair_bins // max(w, t.pair_bins) for w in widths]
    model = Additive(float(np.log(rate / (1 - rate))), edges, [np.zeros(w) for w in widths], coarse)
    if not len(y) or y.min() == y.max():
        return model
    binned = model.bins(x)
    logit = model.logit(binned)
    counts = [np.bincount(binned[:, k], minlength=w) for k, w in enumerate(widths)]
    for _ in range(t.rounds):
        for k, w in enumerate(widths):
            p = _logistic(logit)
            g = np.bincount(binned[:, k], y - p, minlength=w)
            h = np.bincount(binned[:, k], p * (1 - p), minlength=w)
            step = t.rate * _tree(g, h, counts[k], t)
            model.tables[k] += step
            logit += step[binned[:, k]]
    sides = [c.max() + 1 for c in coarse]

    def grid(a: int, b: int, weights: np.ndarray | None) -> np.ndarray:
        cell = coarse[a][binned[:, a]] * sides[b] + coarse[b][binned[:, b]]
        return np.bincount(cell, weights, minlength=sides[a] * sides[b]).reshape(sides[a], sides[b]).astype(float)

    p = _logistic(logit)
    gains = []
    for a, b in combinations(range(len(widths)), 2):
        _, gain = _pair_tree(grid(a, b, y - p), grid(a, b, p * (1 - p)), grid(a, b, None), t)
        gains.append((gain, a, b))
    chosen = [(a, b) for gain, a, b in sorted(gains, reverse=True)[: t.pairs] if gain > 0]
    model.pairs = {(a, b): np.zeros((sides[a], sides[b])) for a, b in chosen}
    for _ in range(t.pair_rounds):
        for a, b in chosen:
            p = _logistic(logit)
            step = t.rate * _pair_tree(grid(a, b, y - p), grid(a, b, p * (1 - p)), grid(a, b, None), t)[0]
            model.pairs[a, b] += step
            logit += step[coarse[a][binned[:, a]], coarse[b][binned[:, b]]]
    return model


# ---------------------------------------------------------------- Spark


@F.pandas_udf(ArrayType(DoubleType()))
def _features(texts: pd.Series) -> pd.Series:
    return pd.Series([features(t) for t in texts_of(texts)], dtype=object)


def fit(docs: DataFrame, labels: DataFrame, t: Training = Training(), text: str = "text") -> Additive:
    """Learns from labelled rows outside the held-out part; a document's label is the largest it is given.

    Of an id with several texts one is learnt (by hash).
    """
    given = labels.where("quality is not null and doc_id is not null").where(~is_held_out(F.col("doc_id")))
    given = given.groupBy("doc_id").agg(F.max("quality").alias("y"))
    # The sample is drawn among the labels before any text is read.
    given = given.orderBy(F.xxhash64("doc_id")).limit(t.sample)
    rows = docs.select("doc_id", F.col(f"`{text}`").cast("string").alias("text")).join(F.broadcast(given), "doc_id")
    rows = rows.select("doc_id", "y", _features("text").alias("x"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("h"))
    sample = rows.groupBy("doc_id", "y").agg(F.min_by("x", "h").alias("x")).orderBy("doc_id").toPandas()  # ids may repeat
    x = np.array(sample["x"].tolist(), float).reshape(len(sample), len(FEATURES))
    return train(x, sample["y"].to_numpy(float), t)


def scored(docs: DataFrame, model: Additive, into: str = "score", text: str = "text") -> DataFrame:
    """``docs`` with the quality of each whole text (0 to 1) in a new column.

    A null text is scored as an empty one; repeated rows score alike.
    """
    if into.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"the table has a column {into} already")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def quality(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            x = np.array([features(t) for t in texts_of(texts)], float).reshape(len(texts), len(FEATURES))
            yield pd.Series(shared.value.score(x), dtype="float64")

    return docs.withColumn(into, quality(F.col(f"`{text}`").cast("string")))


def report(docs: DataFrame, labels: DataFrame, t: Training = Training()) -> DataFrame:
    docs = docs.select("doc_id", "text")
    return scored(docs, fit(docs, labels, t)).select(
        "doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score",
        F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"),
    )


def of_quality(docs: DataFrame, labels: DataFrame, limit: float = 0.3, t: Training = Training()) -> DataFrame:
    """``docs`` that score ``limit`` or more, in their own columns."""
    score = fresh_name(docs.columns, "score")
    return scored(docs, fit(docs, labels, t), score).where(F.col(score) >= limit).drop(score)
