"""Toxicity and quality: gradients, held-out accuracy, and awkward rows."""

import random
import zlib

import numpy as np
import pytest
from corpus_helpers import extra
from pyspark.sql import functions as F

from tripledger.llm import quality, toxicity

DOCS = "doc_id long, text string"
SMALL = toxicity.Training(toxic=60, clean=120, rows=1 << 10, known_words=400, rounds=3, epochs=4, others=200)


def prose(draw, n):
    return " ".join(draw.choice(["the", "of", "and", "tion", "ing", "re"]) + draw.choice(["an", "st", "or", "ed", ""]) for _ in range(n))


def corpus(n=260, seed=1):
    """Every third document holds a slur or an unseen form of one; every fourth is of low quality."""
    draw = random.Random(seed)
    rows, labels = [], []
    for k in range(n):
        words = prose(draw, draw.randrange(5, 120)).split()
        toxic = k % 3 == 0
        for _ in range(3 * toxic):
            words.insert(draw.randrange(len(words) + 1), "zlurp" + draw.choice("abcdefghijklmnop") + draw.choice("aeiou"))
        bad = k % 4 == 0
        text = " ".join(words).upper() + "!!! $$$ ###" if bad else " ".join(words) + "."
        rows.append((k, text))
        labels.append((k, int(not bad), int(toxic)))
    return rows, labels


@pytest.fixture
def tables(spark):
    rows, labels = corpus()
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def held_out(k):
    return zlib.crc32(str(k).encode()) % 5 == 0


def test_gradients_agree_with_differences():
    net = toxicity.Network.new({b"ab": 1, b"cd": 2}, toxicity.Training(rows=16, size=3, hidden=2))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    words = [b"ab", b"cd", b"xyz"]
    index = np.array([[1, 2, 3, 1], [3, 3, 0, 0]])
    mask, y = index > 0, np.array([1.0, 0.0])

    def loss():
        table = np.vstack([net.p["input_bias"], net.inputs(words)[0] @ net.p["input"] + net.p["input_bias"]])
        z = net.forward(table, index, mask)
        return float(np.mean(np.log1p(np.exp(z)) - y * z))

    found = net.gradient(words, index, mask, y)
    draw = np.random.default_rng(0)
    for name, values in net.p.items():
        for _ in range(6):
            at = tuple(draw.integers(0, s) for s in values.shape)
            keep, step = values[at], 1e-3
            values[at] = keep + step
            up = loss()
            values[at] = keep - step
            down = loss()
            values[at] = keep
            assert found[name][at] == pytest.approx((up - down) / (2 * step), abs=3e-4), name


def test_windows_overlap_and_cover_the_whole_text():
    for n in (0, 1, 31, 32, 33, 56, 57, 1000):
        begins = toxicity.windows_of(n)
        covered = {p for b in begins for p in range(b, min(b + toxicity.WINDOW, max(n, 1)))}
        assert covered == set(range(max(n, 1))) and all(np.diff(begins) <= toxicity.STRIDE)


def test_toxic_documents_are_found_beyond_the_sample(tables):
    docs, labels = tables
    found = toxicity.report(extra(docs), extra(labels), SMALL)
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    rows = found.collect()
    assert found.columns == ["doc_id", "held_out", "score", "predicted"] and len(rows) == len(truth)
    assert all(r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    tested = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == truth[r.doc_id] for r in tested]) > 0.93
    kept = toxicity.acceptable(extra(docs), labels, t=SMALL)
    assert kept.columns == extra(docs).columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if r.score < 0.5}


def test_one_slur_in_a_very_long_text_counts(tables):
    docs, labels = tables
    scorer = toxicity.Scorer(toxicity.fit(docs, labels, SMALL))
    draw = random.Random(9)
    clean = prose(draw, 150_000)
    scores = scorer.score([clean, clean + " zlurpqa zlurpqe zlurpqi " + prose(draw, 9), "", "the of"])
    assert scores[0] < 0.5 < scores[1] and scores[3] < 0.5
    # Steps and a full memory change nothing.
    rows = [r.text for r in docs.collect()][:60]
    whole = scorer.score(rows)
    alone = toxicity.Scorer(scorer.net)
    assert np.allclose(whole, [alone.score([x])[0] for x in rows], atol=1e-5)


def test_a_full_memory_changes_no_score(tables, monkeypatch):
    docs, labels = tables
    net = toxicity.fit(docs, labels, SMALL)
    rows = [r.text for r in docs.collect()][:60]
    want = toxicity.Scorer(net).score(rows)
    monkeypatch.setattr(toxicity, "REMEMBERED", 20)
    monkeypatch.setattr(toxicity, "STEP_WORDS", 50)
    assert np.allclose(toxicity.Scorer(net).score(rows), want, atol=1e-5)


AWKWARD = [(1, None), (1, ""), (2, "x"), (None, "x"), (3, "\n \t"), (3, "é" * 20000), (4, "!!! ###")]


@pytest.mark.parametrize("operator", [toxicity, quality])
def test_awkward_rows_and_empty_tables(spark, tables, operator):
    docs, labels = tables
    t = SMALL if operator is toxicity else quality.Training()
    odd = docs.unionByName(spark.createDataFrame(AWKWARD, DOCS))
    extra_labels = spark.createDataFrame([(None, 1, 1), (5, None, None), (0, 1, 0)], labels.schema)
    found = operator.report(odd, labels.unionByName(extra_labels), t).collect()
    assert len(found) == odd.count() and all(0 <= r.score <= 1 for r in found)
    by_text = [r.score for r in found if r.doc_id is None]
    assert len(by_text) == 1
    assert operator.report(docs.limit(0), labels, t).count() == 0
    alone = operator.report(docs, labels.limit(0), t)
    assert alone.count() == docs.count() and alone.select("score").distinct().count() == 1
    one_class = labels.withColumns({"toxic": F.lit(0), "quality": F.lit(1)})
    assert operator.report(docs, one_class, t).where("score is null").count() == 0


def test_long_texts_and_repeated_ids_are_learnt(spark, monkeypatch):
    given = {}
    monkeypatch.setattr(toxicity, "train", lambda texts, y, t: given.update(zip(texts, y.tolist(), strict=True)))
    numbered = " ".join(f"w{k:06d}" for k in range(9000))
    ids = [k for k in range(60) if zlib.crc32(str(k).encode()) % 5]
    rows = [(ids[0], numbered), (ids[1], None), (ids[2], "")] + [(ids[3], f"one of many {k}") for k in range(40)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, k % 2) for k, i in enumerate(ids)], "doc_id long, toxic int")
    toxicity.fit(docs, labels, toxicity.Training(chars=10_000))
    assert len(given) == 3 and given[""] == 0  # a missing text teaches nothing
    (long,) = [x for x in given if x.startswith("w")]
    assert 10_000 <= len(long) < 10_100 and long.endswith(numbered[-1000:]) and long.startswith(numbered[:1000])
    assert all(f"w{1000 * k:06d}"[:4] in long for k in range(9))
    (repeated,) = [x for x in given if x.startswith("one")]
    toxicity.fit(docs.repartition(7), labels, toxicity.Training(chars=10_000))
    assert repeated in given and len(given) == 3


def test_labels_of_the_held_out_part_are_never_learnt(tables):
    docs, labels = tables
    turned = labels.where(toxicity.is_held_out(F.col("doc_id"))).withColumns(
        {"toxic": 1 - F.col("toxic"), "quality": 1 - F.col("quality")}
    )
    learnt = labels.where(~toxicity.is_held_out(F.col("doc_id")))
    for operator, t in ((toxicity, SMALL), (quality, quality.Training(rounds=10, pair_rounds=2))):
        a = {r.doc_id: r.score for r in operator.report(docs, labels, t).collect()}
        b = {r.doc_id: r.score for r in operator.report(docs, learnt.unionByName(turned), t).collect()}
        assert a == b


def test_quality_is_learnt(tables):
    docs, labels = tables
    truth = {r.doc_id: r.quality for r in labels.collect()}
    rows = quality.report(extra(docs), extra(labels)).collect()
    tested = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == truth[r.doc_id] for r in tested]) > 0.95
    assert all(r.predicted == (r.score >= 0.3) for r in rows)
    kept = quality.of_quality(extra(docs), labels)
    assert kept.columns == extra(docs).columns and kept.count() == sum(r.score >= 0.3 for r in rows)


def test_a_score_is_a_sum_of_table_entries_and_pairs_find_an_interaction():
    draw = np.random.default_rng(3)
    x = np.zeros((4000, len(quality.FEATURES)))
    x[:, 0], x[:, 1] = draw.random(4000), draw.random(4000)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.train(x, y)
    assert (0, 1) in model.pairs and ((model.score(x) > 0.5) == y).mean() > 0.95
    b = model.bins(x[:1])[0]
    total = model.base + sum(t[b[k]] for k, t in enumerate(model.tables))
    total += sum(t[model.coarse[i][b[i]], model.coarse[j][b[j]]] for (i, j), t in model.pairs.items())
    assert model.logit(model.bins(x[:1]))[0] == pytest.approx(total)
    main_effects = quality.train(x, y, quality.Training(pairs=0))
    assert ((main_effects.score(x) > 0.5) == y).mean() < 0.7
