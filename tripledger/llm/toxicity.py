"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters as two vectors: its own, if the training sample knows the word, and the mean of its
character runs' vectors (3 to 5 UTF-8 bytes, word boundaries included, hashed into a fixed number of
rows). Two gated recurrent layers read a window of words from both ends; attention weighs the states; a
logistic unit gives the window's score. A document's score is that of its worst window, over
overlapping windows that cover its whole text.

Labels say which documents are toxic, not where, so training takes turns: score all windows of the
sample, then learn from each document's worst window and a few others of the clean ones.

The fit uses a bounded sample of labelled rows (``Training``), by hash of ``doc_id``; scoring is one
pass over all texts without a shuffle, and holds a bounded number of word projections in memory.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripledger.llm.common import at_rest, fresh_name, is_held_out, small_batches, sole_memory, texts_of
from tripledger.llm.decontaminate import words_of

WINDOW = 32
STRIDE = 24
#: Word projections a worker keeps, and windows scored in one step.
REMEMBERED = 120_000
STEP_WINDOWS = 4096
STEP_WORDS = 60_000
#: Characters of a stretch that a long text gives the sample.
STRETCH = 1000
#: Distinct words whose character runs are looked up in one step.
STEP_NAMES = 8_192


@dataclass(frozen=True)
class Training:
    """Bounds of the labelled sample, and how it is learnt."""

    toxic: int = 1200
    clean: int = 3600
    chars: int = 20_000  # a longer text gives the sample so many, in stretches spread over the whole of it
    known_words: int = 8192
    rows: int = 1 << 15
    size: int = 12
    hidden: int = 8
    rounds: int = 6
    others: int = 4000  # further windows of clean documents in each round
    epochs: int = 3
    batch: int = 256
    rate: float = 0.01
    seed: int = 7


# ---------------------------------------------------------------- input


def char_runs(words: list[bytes], rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of the words' character runs, word after word, and how many each word has."""
    marked = b"".join(b"\x01" + w + b"\x02" for w in words)
    flat = np.frombuffer(marked, np.uint8).astype(np.uint32)
    lengths = np.array([len(w) + 2 for w in words])
    ends = np.repeat(np.cumsum(lengths), lengths)
    owner = np.repeat(np.arange(len(words)), lengths)
    found, whose = [], []
    for n in (3, 4, 5):
        k = len(flat) - n + 1
        if k <= 0:
            continue
        inside = np.flatnonzero(np.arange(k) + n <= ends[:k])
        code = np.full(len(inside), n, np.uint32)
        for j in range(n):
            code = (code ^ flat[inside + j]) * np.uint32(0x01000193)
        found.append((code ^ (code >> np.uint32(15))) % np.uint32(rows))
        whose.append(owner[inside])
    found, whose = np.concatenate(found), np.concatenate(whose)
    order = np.argsort(whose, kind="stable")
    return found[order].astype(np.int64), np.bincount(whose, minlength=len(words))


def windows_of(n: int) -> np.ndarray:
    """Begins of windows that cover ``n`` words."""
    if n <= WINDOW:
        return np.zeros(1, np.int64)
    return np.append(np.arange(0, n - WINDOW, STRIDE), n - WINDOW)


# ---------------------------------------------------------------- network


def _logistic(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * np.tanh(np.float32(0.5) * x) + np.float32(0.5)


def _sum_rows(index: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of the values' rows by index."""
    order = np.argsort(index, kind="stable")
    ordered = index[order]
    begins = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    out = np.zeros((n, values.shape[1]), np.float32)
    out[ordered[begins]] = np.add.reduceat(values[order], begins, axis=0)
    return out


@dataclass
class Network:
    vocabulary: dict[bytes, int]
    p: dict[str, np.ndarray] = field(default_factory=dict)
    rows: int = 1 << 14
    hidden: int = 8

    @classmethod
    def new(cls, vocabulary: dict[bytes, int], t: Training) -> Network:
        draw = np.random.default_rng(t.seed)
        h, e = t.hidden, t.size

        def normal(*shape: int, scale: float) -> np.ndarray:
            return (draw.standard_normal(shape) * scale).astype(np.float32)

        p = {
            "word": normal(len(vocabulary) + 1, e, scale=0.1),
            "char": normal(t.rows, e, scale=0.3),
            "input": normal(2 * e, 6 * h, scale=(2 * e) ** -0.5),
            "input_bias": np.zeros(6 * h, np.float32),
            "loop": normal(2, h, 3 * h, scale=h**-0.5),
            "attend": normal(2 * h, h, scale=(2 * h) ** -0.5),
            "attend_bias": np.zeros(h, np.float32),
            "attend_out": normal(h, scale=h**-0.5),
            "out": normal(2 * h, scale=(2 * h) ** -0.5),
            "out_bias": np.zeros(1, np.float32),
        }
        return cls(vocabulary, p, t.rows, h)

    def inputs(self, words: list[bytes]) -> tuple[np.ndarray, tuple]:
        """The words' input vectors, and what the backward pass needs."""
        known = np.array([self.vocabulary.get(w, 0) for w in words])
        runs, counts = char_runs(words, self.rows)
        begins = np.concatenate(([0], np.cumsum(counts)[:-1]))
        chars = np.add.reduceat(self.p["char"][runs], begins, axis=0) / counts[:, None].astype(np.float32)
        own = self.p["word"][known] * (known > 0)[:, None]
        return np.hstack([own, chars]).astype(np.float32), (known, runs, counts)

    def projected(self, words: list[bytes]) -> np.ndarray:
        """Both directions' gate inputs of the words: a row of 6 * hidden numbers each."""
        out = np.empty((len(words), 6 * self.hidden), np.float32)
        for a in range(0, len(words), STEP_NAMES):  # character runs of many words take much room
            out[a : a + STEP_NAMES] = self.inputs(words[a : a + STEP_NAMES])[0] @ self.p["input"] + self.p["input_bias"]
        return out

    def forward(self, table: np.ndarray, index: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Window scores (logits). ``index``: table rows of the words, windows by places; row 0 pads."""
        n, steps = index.shape
        h, p = self.hidden, self.p
        state = np.zeros((2, n, h), np.float32)
        states = np.empty((steps, n, 2 * h), np.float32)
        kept = []
        both = table.reshape(len(table), 2, 3 * h)
        ahead, back = np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])
        x = np.empty((2, n, 3 * h), np.float32)
        for t in range(steps):
            np.take(ahead, index[:, t], axis=0, out=x[0])
            np.take(back, index[:, steps - 1 - t], axis=0, out=x[1])
            from_state = np.matmul(state, p["loop"])
            gates = _logistic(x[..., : 2 * h] + from_state[..., : 2 * h])
            z, r = gates[..., :h], gates[..., h:]
            new = np.tanh(x[..., 2 * h :] + r * from_state[..., 2 * h :])
            before, state = state, new + z * (state - new)
            states[t, :, :h] = state[0]
            states[steps - 1 - t, :, h:] = state[1]
            if keep:
                kept.append((before, z, r, new, from_state[..., 2 * h :]))
        hidden = np.tanh(states @ p["attend"] + p["attend_bias"])
        score = hidden @ p["attend_out"]
        score = np.where(mask.T, score, np.float32(-1e9))
        weight = np.exp(score - score.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = np.einsum("tn,tnk->nk", weight, states)
        logit = pooled @ p["out"] + p["out_bias"][0]
        return (logit, (states, hidden, weight, pooled, kept)) if keep else logit

    def gradient(self, words: list[bytes], index: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict:
        """Of the mean logistic loss. ``words``: those that the index, from 1 on, names."""
        p, h = self.p, self.hidden
        x, (known, runs, counts) = self.inputs(words)
        table = np.vstack([p["input_bias"], x @ p["input"] + p["input_bias"]])
        logit, (states, hidden, weight, pooled, kept) = self.forward(table, index, mask, keep=True)
        n, steps = index.shape
        d = ((_logistic(logit) - y) / n).astype(np.float32)
        g = {"out": pooled.T @ d, "out_bias": np.array([d.sum()], np.float32)}
        d_pooled = d[:, None] * p["out"]
        d_states = weight[..., None] * d_pooled
        d_weight = np.einsum("tnk,nk->tn", states, d_pooled)
        d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
        g["attend_out"] = np.einsum("tnk,tn->k", hidden, d_score)
        d_hidden = d_score[..., None] * p["attend_out"] * (1 - hidden**2)
        g["attend"] = np.einsum("tnk,tna->ka", states, d_hidden)
        g["attend_bias"] = d_hidden.sum(axis=(0, 1))
        d_states += d_hidden @ p["attend"].T
        d_table = np.zeros_like(table)
        g["loop"] = np.zeros_like(p["loop"])
        carry = np.zeros((2, n, h), np.float32)
        d_x = np.empty((steps, 2, n, 3 * h), np.float32)
        for t in reversed(range(steps)):
            before, z, r, new, inner = kept[t]
            carry[0] += d_states[t, :, :h]
            carry[1] += d_states[steps - 1 - t, :, h:]
            d_new = carry * (1 - z) * (1 - new**2)
            d_z = carry * (before - new) * z * (1 - z)
            d_r = d_new * inner * r * (1 - r)
            d_x[t] = np.concatenate([d_z, d_r, d_new], axis=-1)
            d_from = np.concatenate([d_z, d_r, d_new * r], axis=-1)
            g["loop"] += np.matmul(before.transpose(0, 2, 1), d_from)
            carry = carry * z + np.matmul(d_from, p["loop"].transpose(0, 2, 1))
        where = index.T.ravel()
        d_table[:, : 3 * h] = _sum_rows(where, d_x[:, 0].reshape(-1, 3 * h), len(table))
        d_table[:, 3 * h :] = _sum_rows(where, d_x[::-1, 1].reshape(-1, 3 * h), len(table))
        g["input_bias"] = d_table.sum(axis=0)
        d_table = d_table[1:]
        g["input"] = x.T @ d_table
        d_in = d_table @ p["input"].T
        e = d_in.shape[1] // 2
        g["word"] = _sum_rows(known, d_in[:, :e] * (known > 0)[:, None], len(p["word"]))
        spread = np.repeat(d_in[:, e:] / counts[:, None], counts, axis=0).astype(np.float32)
        g["char"] = _sum_rows(runs, spread, len(p["char"]))
        return g


# ---------------------------------------------------------------- training


def _laid_out(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of documents given as word numbers from 1 (0 pads); the mask; the window's document."""
    ids = np.concatenate([*docs, np.zeros(WINDOW, np.int32)])
    begins, owners, limits, at = [], [], [], 0
    for k, d in enumerate(docs):
        some = windows_of(len(d))
        begins.append(some + at)
        owners.append(np.full(len(some), k))
        at += len(d)
        limits.append(np.full(len(some), at))
    begins, owners, limits = map(np.concatenate, (begins, owners, limits))
    places = begins[:, None] + np.arange(WINDOW)
    mask = places < limits[:, None]
    index = np.where(mask, ids[np.minimum(places, len(ids) - 1)], 0)
    mask[:, 0] = True  # an empty text is one window of padding
    return index, mask, owners


def train(texts: Iterable[str], labels: np.ndarray, t: Training = Training()) -> Network | None:
    """None if the sample lacks one of the classes."""
    if not len(labels) or labels.min() == labels.max():
        return None
    names: dict[bytes, int] = {}
    docs = [np.array([names.setdefault(w, len(names) + 1) for w in words_of(x)], np.int32) for x in texts]
    words = list(names)
    seen = dict(zip(words, np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=len(words) + 1)[1:].tolist(), strict=True))
    common = sorted((w for w, c in seen.items() if c > 1), key=lambda w: (-seen[w], w))[: t.known_words]
    net = Network.new({w: k + 1 for k, w in enumerate(common)}, t)
    index, mask, owners = _laid_out(docs)
    truth = labels[owners].astype(np.float32)
    draw = np.random.default_rng(t.seed)
    first = {k: np.zeros_like(v) for k, v in net.p.items()}
    second = {k: np.zeros_like(v) for k, v in net.p.items()}
    step = 0
    for turn in range(t.rounds):
        if turn == 0:
            score = draw.random(len(owners)).astype(np.float32)
        else:
            table = np.vstack([net.p["input_bias"], net.projected(words)])
            parts = range(0, len(owners), STEP_WINDOWS)
            score = np.concatenate([net.forward(table, index[a : a + STEP_WINDOWS], mask[a : a + STEP_WINDOWS]) for a in parts])
        order = np.lexsort((-score, owners))
        place = np.arange(len(order)) - np.searchsorted(owners[order], owners[order])
        chosen = order[place < np.where(truth[order] > 0, 4 if turn == 0 else 1, 3)]
        chosen = np.concatenate([chosen, draw.choice(np.flatnonzero(truth == 0), min(t.others, int((truth == 0).sum())), False)])
        for _ in range(t.epochs):
            draw.shuffle(chosen)
            for a in range(0, len(chosen), t.batch):
                some = chosen[a : a + t.batch]
                used, small = np.unique(index[some], return_inverse=True)
                small = small.reshape(len(some), WINDOW)
                if used[0] != 0:
                    small, used = small + 1, np.concatenate(([0], used))
                names = [words[k - 1] for k in used[1:]] or [b"\x03"]
                grads = net.gradient(names, small, mask[some], truth[some])
                step += 1
                for k, g in grads.items():
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.001 * (g * g - second[k])
                    fast = first[k] / (1 - 0.9**step)
                    net.p[k] -= (t.rate * fast / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-6)).astype(np.float32)
    return net


def _spread(text: str, chars: int) -> Column:
    """The text, or of a longer one ``chars`` characters: stretches from its begin to its end at even distances."""
    n = max(2, chars // STRETCH)
    size = chars // n
    begin = f"1 + int(bigint(k) * (length(`{text}`) - {size}) / {n - 1})"
    stretches = f"array_join(transform(sequence(0, {n - 1}), k -> substr(`{text}`, {begin}, {size})), ' ')"
    return F.expr(f"CASE WHEN length(`{text}`) > {chars} THEN {stretches} ELSE `{text}` END")


def fit(docs: DataFrame, labels: DataFrame, t: Training = Training(), text: str = "text") -> Network | None:
    """Learns from labelled rows outside the held-out part; a document's label is the largest it is given.

    Of an id with several texts one is learnt (by hash). A text longer than ``t.chars`` takes part with stretches that lie
    evenly over the whole of it.
    """
    given = labels.where("toxic is not null and doc_id is not null").where(~is_held_out(F.col("doc_id")))
    given = given.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    # The sample is drawn among the labels before any text is read; it is bounded, and so is what comes back.
    chosen = [given.where(F.col("y") == y).orderBy(F.xxhash64("doc_id")).limit(n) for y, n in ((1, t.toxic), (0, t.clean))]
    chosen = F.broadcast(chosen[0].unionByName(chosen[1]))
    rows = docs.select("doc_id", F.col(f"`{text}`").cast("string").alias("text")).where("text is not null").join(chosen, "doc_id")
    rows = rows.select("doc_id", "y", _spread("text", t.chars).alias("text"))
    rows = rows.groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))  # ids may repeat
    sample = sorted((r["text"], r["y"]) for r in rows.collect())  # the order of arrival must not matter
    return train((x for x, _ in sample), np.array([y for _, y in sample]), t)


# ---------------------------------------------------------------- scoring


class Scorer:
    def __init__(self, net: Network):
        self.net = net
        self._reset()

    def _reset(self) -> None:
        self.rows: dict[bytes, int] = {}
        self.table = np.empty((REMEMBERED + 1, 6 * self.net.hidden), np.float32)
        self.table[0] = self.net.p["input_bias"]

    def _known(self, words: set[bytes]) -> None:
        new = [w for w in words if w not in self.rows]
        if len(self.rows) + len(new) > REMEMBERED:
            self.rows.clear()
            new = list(words)
            if len(new) > len(self.table) - 1:
                self.table = np.empty((len(new) + 1, self.table.shape[1]), np.float32)
                self.table[0] = self.net.p["input_bias"]
        if new:
            begin = len(self.rows) + 1
            self.table[begin : begin + len(new)] = self.net.projected(new)
            self.rows.update(zip(new, range(begin, begin + len(new)), strict=True))

    def _windows(self, words: list[bytes]) -> np.ndarray:
        """Logits of a text's windows, for texts of any length."""
        out = []
        begins = windows_of(len(words))
        for a in range(0, len(begins), STEP_WINDOWS):
            some = begins[a : a + STEP_WINDOWS]
            part = words[some[0] : some[-1] + WINDOW]
            out.append(self._step([part], some - some[0], np.full(len(some), len(part)), len(part)))
        return np.concatenate(out)

    def _step(self, docs: list[list[bytes]], begins: np.ndarray, limits: np.ndarray, total: int) -> np.ndarray:
        self._known({w for d in docs for w in d})
        get = self.rows.__getitem__
        ids = np.zeros(total + WINDOW, np.int64)
        at = 0
        for d in docs:
            ids[at : at + len(d)] = list(map(get, d))
            at += len(d)
        places = begins[:, None] + np.arange(WINDOW)
        mask = places < limits[:, None]
        index = np.where(mask, ids[np.minimum(places, len(ids) - 1)], 0)
        mask[:, 0] = True
        parts = range(0, len(begins), STEP_WINDOWS)
        return np.concatenate([self.net.forward(self.table, index[a : a + STEP_WINDOWS], mask[a : a + STEP_WINDOWS]) for a in parts])

    def score(self, texts: list[str]) -> np.ndarray:
        out = np.empty(len(texts))
        k = 0
        while k < len(texts):
            docs, owners, begins, limits, total, first = [], [], [], [], 0, k
            while k < len(texts) and (not docs or total < STEP_WORDS):
                words = words_of(texts[k])
                if len(words) > STEP_WORDS:
                    if docs:
                        break
                    out[k] = self._windows(words).max()
                    k += 1
                    first = k
                    continue
                some = windows_of(len(words))
                docs.append(words)
                owners.append(np.full(len(some), k - first))
                begins.append(some + total)
                total += len(words)
                limits.append(np.full(len(some), total))
                k += 1
            if docs:
                logits = self._step(docs, np.concatenate(begins), np.concatenate(limits), total)
                starts = np.concatenate(([0], np.cumsum([len(o) for o in owners])[:-1]))
                out[first:k] = np.maximum.reduceat(logits, starts)
        return _logistic(out.astype(np.float64))


def scored(docs: DataFrame, net: Network | None, into: str = "score", text: str = "text") -> DataFrame:
    """``docs`` with the toxicity of each whole text (0 to 1) in a new column.

    A null or wordless text is scored as a window of padding; repeated rows score alike; without a
    trained network every score is 0; an empty table stays empty. Sets ``common.small_batches`` for the session.
    """
    if into.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"the table has a column {into} already")
    if net is None:
        return docs.withColumn(into, F.lit(0.0))
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(net)

    @F.pandas_udf("double")
    def toxicity(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        sole_memory("toxicity")
        scorer = Scorer(shared.value)
        for texts in batches:
            yield pd.Series(scorer.score(texts_of(texts)), dtype="float64")
        del scorer
        at_rest()

    return docs.withColumn(into, toxicity(F.col(f"`{text}`").cast("string")))


def report(docs: DataFrame, labels: DataFrame, t: Training = Training()) -> DataFrame:
    docs = docs.select("doc_id", "text")
    found = scored(docs, fit(docs, labels, t))
    return found.select(
        "doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


def acceptable(docs: DataFrame, labels: DataFrame, limit: float = 0.5, t: Training = Training()) -> DataFrame:
    """``docs`` without those that score ``limit`` or more, in their own columns."""
    score = fresh_name(docs.columns, "score")
    return scored(docs, fit(docs, labels, t), score).where(F.col(score) < limit).drop(score)
