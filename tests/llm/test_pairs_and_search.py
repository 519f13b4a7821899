"""N-gram Jaccard join, connected components and top-k search against brute force."""

import random
import re
from itertools import combinations

import numpy as np
import pytest
from corpus_helpers import extra
from pyspark.sql import functions as F

from tripledger.llm import jaccard, kd_search
from tripledger.llm.bitmap import may_be_wanted, those_maybe_wanted
from tripledger.llm.components import components
from tripledger.llm.jaccard import Likeness

WORDS = [f"w{k}" for k in range(60)]
DOCS = "doc_id long, text string"


def shingles(text, width):
    plain = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", plain)
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + width]) for k in range(max(len(words) - width, 0) + 1))


def brute_classes(docs, like):
    sets = [shingles(t, like.width) for _, t in docs]
    home = list(range(len(docs)))

    def root(k):
        while home[k] != k:
            k = home[k]
        return k

    for a, b in combinations(range(len(docs)), 2):
        common = len(sets[a] & sets[b])
        if common and like.den * common >= like.num * (len(sets[a]) + len(sets[b]) - common):
            home[root(a)] = root(b)
    least = {}
    for k, (key, _) in enumerate(docs):
        least[root(k)] = min(key, least.get(root(k), key))
    return {(key, len(sets[k]), least[root(k)]) for k, (key, _) in enumerate(docs)}


def family(seed, copies, length, edits):
    """A text and near copies of it with up to ``edits`` words changed."""
    draw = random.Random(seed)
    first = [draw.choice(WORDS) + str(draw.randrange(40)) for _ in range(length)]
    texts = [" ".join(first)]
    for _ in range(copies):
        copy = list(first)
        for _ in range(draw.randrange(edits + 1)):
            copy[draw.randrange(length)] = f"x{draw.randrange(10**6)}"
        if draw.random() < 0.3:
            copy = copy[: -draw.randrange(1, 4)]
        texts.append(" ".join(copy))
    return texts


@pytest.mark.parametrize("like", [Likeness(3, 90, 100), Likeness(5, 8, 10), Likeness(1, 1, 2)])
def test_components_equal_brute_force(spark, like):
    texts = []
    for seed, length in enumerate([4, 9, 11, 20, 40, 80, 150, 150, 300]):
        texts += family(seed, 14, length, max(1, length // 25))
    texts += ["same words here", "Same  words\nhere", "", None, "  ", "a", "A", "b", "a b", "é É é É", "é É é É x"]
    random.Random(3).shuffle(texts)
    docs = list(enumerate(texts, 100))
    found = jaccard.classes(extra(spark.createDataFrame(docs, DOCS)), like)
    assert {tuple(r) for r in found.collect()} == brute_classes(docs, like)


def test_a_large_family_takes_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 8)
    monkeypatch.setattr(jaccard, "BLOCK_GRAMS", 700)
    like = Likeness(3, 90, 100)
    docs = list(enumerate(family(5, 90, 100, 3) + family(6, 40, 100, 2)))
    found = jaccard.classes(spark.createDataFrame(docs, DOCS), like)
    assert {tuple(r) for r in found.collect()} == brute_classes(docs, like)


def test_linked_sets_share_a_token():
    """The signature's guarantee, for sets of every small size and just enough in common."""
    draw = np.random.default_rng(1)
    for like in (Likeness(3, 90, 100), Likeness(5, 8, 10)):
        for n in [*range(1, 60), 100, 250, 1000]:
            for _ in range(8):
                a = np.unique(draw.integers(0, 2**64, n, dtype=np.uint64))
                drop = int(draw.integers(0, like.differing(n) + 1))
                new = draw.integers(0, 2**64, int(draw.integers(0, like.differing(n) - drop + 1)), dtype=np.uint64)
                b = np.unique(np.concatenate([draw.permutation(a)[drop:], new]))
                common = len(np.intersect1d(a, b))
                if common and like.den * common >= like.num * (len(a) + len(b) - common):
                    one, other = jaccard.signature(a, like), jaccard.signature(b, like)
                    assert np.array_equal(a, b) or len(np.intersect1d(one, other))


def test_awkward_rows(spark):
    text = " ".join(WORDS)
    rows = [(1, text), (1, text), (2, text), (2, "other words than these"), (None, text), (None, None), (7, None)]
    found = jaccard.classes(spark.createDataFrame(rows, DOCS), Likeness(3, 90, 100))
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in found.collect()) == [
        (0, 0, None), (0, 58, None), (1, 58, 1), (1, 58, 1), (2, 2, 2), (2, 58, 1), (7, 0, 7)
    ]
    empty = jaccard.classes(spark.createDataFrame([], DOCS))
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_shingles", "component_id"]


def test_workers_that_wait_keep_no_words(spark):
    rows = [(k, f"word{k} other{k} " * 40) for k in range(200)]
    jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()

    def kept(batches):
        for batch in batches:
            yield batch.assign(id=len(jaccard._words))

    assert {r[0] for r in spark.range(0, 64, 1, 8).mapInPandas(kept, "id long").collect()} == {0}


def test_one_of_each_group_stays_in_its_own_columns(spark):
    text = " ".join(WORDS)
    rows = [(5, text), (3, text + " end"), (3, text + " end"), (9, "alone here"), (None, text), (8, None)]
    docs = extra(spark.createDataFrame(rows, DOCS))
    kept = jaccard.first_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == [
        (0, text), (3, text + " end"), (8, None), (9, "alone here")
    ]


@pytest.mark.parametrize("seed", range(3))
def test_connected_components(spark, seed):
    draw = random.Random(seed)
    edges = [(draw.randrange(80), draw.randrange(80)) for _ in range(60)] + [(200 + k, 201 + k) for k in range(20)] + [(5, None)]
    found = {r.node: r.label for r in components(spark.createDataFrame(edges, "u int, v int")).collect()}
    label = {k: k for e in edges if None not in e for k in e}
    for _ in label:
        for a, b in (e for e in edges if None not in e):
            label[a] = label[b] = min(label[a], label[b])
    assert found == {k: v for k, v in label.items() if k != v}


VECTORS = "vec_id long, embedding array<float>"


def brute_top(rows, k, every, scale=64):
    points = {i: np.floor(np.array(v, np.float64) * scale).astype(int) for i, v in rows}
    out = set()
    for q in (i for i in points if i % every == 0):
        best = sorted((-int(points[q] @ points[p]), p) for p in points if p != q and len(points[p]) == len(points[q]))
        out |= {(q, rank, p, -s) for rank, (s, p) in enumerate(best[:k], 1)}
    return out


@pytest.mark.parametrize("shard", [7, 40, 10_000])
def test_top_k_equals_brute_force(spark, shard, monkeypatch):
    monkeypatch.setattr(kd_search, "LEAF", 4)
    monkeypatch.setattr(kd_search, "BLOCK", 5)
    draw = np.random.default_rng(4)
    centres = draw.normal(size=(5, 6))
    rows = [(int(k), (centres[k % 5] + draw.normal(size=6) / 9).astype(np.float32).tolist()) for k in draw.permutation(160)]
    rows += [(k, [0.5] * 6) for k in range(200, 240)]  # ties go to the smaller id
    rows += [(k, [1.0, -2.0]) for k in (300, 301)]  # meet each other only
    found = kd_search.top_k(extra(spark.createDataFrame(rows, VECTORS)), 7, 20, shard=shard)
    assert {tuple(r) for r in found.select("query_id", "rank", "vec_id", "score").collect()} == brute_top(rows, 7, 20)


def coarse_identity():
    """An identity whose first half takes three values only."""

    def coarse(raw):  # in here, so that tasks get it by value
        import zlib

        return zlib.crc32(raw) % 3, zlib.crc32(raw)

    return coarse


def test_sets_that_share_half_a_hash_are_kept_apart(spark):
    docs = list(enumerate(family(5, 12, 40, 3) + family(6, 8, 30, 2) + [f"alone {k} of its own" for k in range(9)] + ["", None]))
    like = Likeness(3, 8, 10)
    found = jaccard.classes(spark.createDataFrame(docs, DOCS), like, identify=coarse_identity())
    assert {tuple(r) for r in found.collect()} == brute_classes(docs, like)


@pytest.mark.parametrize("identify", [jaccard._identity, coarse_identity()])
def test_of_each_group_one_text_stays_whatever_its_id(spark, identify):
    a, b, c = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    docs = [
        (1, a), (2, a), (2, b), (3, a + " more"), (3, c), (3, c), (3, c + " more"), (4, None), (4, None), (4, ""),
        (None, a), (None, a), (5, "few words"), (5, "few words"), (6, "few words"), (7, b), (8, "other"), (8, "another"),
    ]
    table = spark.createDataFrame(docs, DOCS)
    found = jaccard.first_of_each(table, Likeness(5, 8, 10), identify=identify)
    assert found.columns == table.columns
    kept = [(1, a), (2, b), (4, None), (4, None), (4, ""), (None, a), (None, a), (5, "few words"), (8, "other"), (8, "another")]
    rows = [tuple(r) for r in found.collect()]
    assert sorted(map(str, (r for r in rows if r[0] != 3))) == sorted(map(str, kept))
    assert [r[1] in (c, c + " more") for r in rows if r[0] == 3] == [True]


def test_one_row_of_each_group_in_a_table_of_maps_and_clashing_names(spark):
    rows = [(1, "x y z", 1), (1, "x y z", 2), (2, "x y z", 3), (3, "alone", 4)]
    table = spark.createDataFrame(rows, "doc_id int, text string, maybe int").withColumns(
        {"m": F.create_map(F.lit("k"), F.col("maybe")), "key": F.lit(1), "part": F.lit("p")}
    )
    found = jaccard.first_of_each(table).collect()
    assert sorted((r.doc_id, r.text) for r in found) == [(1, "x y z"), (3, "alone")]
    assert all(r.m == {"k": r.maybe} for r in found)
    assert jaccard.first_of_each(table.limit(0)).collect() == []


def test_vectors_that_take_no_part(spark):
    rows = [(0, [1.0, 2.0]), (1, [0.5, 0.5]), (2, None), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, []),
            (6, [float("inf"), 1.0]), (None, [9.0, 9.0]), (1, [0.5, 0.5]), (1, [7.0, 7.0])]
    found = kd_search.top_k(spark.createDataFrame(rows, VECTORS), 5, 20).collect()
    # Every row of a repeated id is a candidate.
    assert [tuple(r) for r in found] == [(0, 1, 1, 64 * 448 + 128 * 448), (0, 2, 1, 64 * 32 + 128 * 32), (0, 3, 1, 64 * 32 + 128 * 32)]
    assert kd_search.top_k(spark.createDataFrame([], VECTORS)).count() == 0
    assert kd_search.top_k(spark.createDataFrame([(0, [1.0])], VECTORS)).count() == 0


def test_repeated_ids_give_what_the_sql_gives(spark):
    import duckdb
    import pandas as pd

    from tripledger.llm.oracle import OP1

    draw = np.random.default_rng(8)
    rows = [(int(k), draw.normal(size=3).astype(np.float32).tolist()) for k in draw.integers(0, 45, 300)]
    rows += [(20, [1.0, 0.0, 0.0]), (1, [1.0, 0.0, 0.0]), (1, [5.0, 0.0, 0.0])]
    con = duckdb.connect()
    con.register("frame", pd.DataFrame(rows, columns=["vec_id", "embedding"]))
    con.execute("CREATE VIEW embeddings AS SELECT vec_id, CAST(embedding AS FLOAT[]) AS embedding FROM frame")
    found = kd_search.top_k(spark.createDataFrame(rows, VECTORS), shard=64)
    assert sorted(tuple(r) for r in found.collect()) == sorted(con.execute(OP1).fetchall())


def test_a_tree_is_cut_short_and_its_boxes_are_tight():
    draw = np.random.default_rng(2)
    points = np.concatenate([draw.integers(-5, 6, (500, 4)) + c for c in (0, 200, -300)])
    tree = kd_search.Tree.build(np.arange(len(points)), points, leaf=16)
    leaves = int((tree.child == 0).sum())
    for low, high, a, b in zip(tree.low, tree.high, tree.begin, tree.end, strict=True):
        assert (tree.points[a:b].min(axis=0) == low).all() and (tree.points[a:b].max(axis=0) == high).all()
    best = [kd_search.Best(5)]
    assert kd_search.search(tree, np.array([-1]), np.array([[3, 1, 2, 1]]), best) < leaves / 4
    scores = points @ np.array([3, 1, 2, 1])
    order = np.lexsort((np.arange(len(points)), -scores))[:5]
    assert best[0].ids.tolist() == order.tolist() and best[0].scores.tolist() == scores[order].tolist()
    # What one tree gave cuts the next one short.
    lower = kd_search.Tree.build(np.arange(len(points)), points - 1000, leaf=16)
    assert kd_search.search(lower, np.array([-1]), np.array([[3, 1, 2, 1]]), best) == 0


def test_sums_too_large_for_floating_point_are_exact():
    points = np.array([[2**27, 1], [2**27, 0], [1, 1]])
    best = [kd_search.Best(2)]
    kd_search.search(kd_search.Tree.build(np.arange(3), points), np.array([9]), np.array([[2**27, 1]]), best)
    assert best[0].scores.tolist() == [2**54 + 1, 2**54]


def test_extra_columns_do_not_matter(spark):
    rows = spark.createDataFrame([(0, [1.0]), (1, [2.0])], VECTORS).withColumn("dim", F.lit("x")).withColumn("v", F.lit(1))
    assert kd_search.top_k(rows).count() == 1


def test_a_bitmap_lets_all_wanted_values_pass(spark):
    draw = np.random.default_rng(6)
    values = draw.integers(-(2**63), 2**63, 4000, dtype=np.int64)
    wanted = spark.createDataFrame([(int(v),) for v in values[:500]], "k long")
    rows = spark.createDataFrame([(int(v),) for v in values], "k long")
    passed = {r.k for r in rows.where(may_be_wanted(wanted, "k", F.col("k"))).collect()}
    assert set(values[:500].tolist()) <= passed and len(passed) < 510
    arrays = rows.select(F.array("k", F.lit(int(values[0])), F.lit(5)).alias("a"))
    kept = arrays.select(those_maybe_wanted(wanted, "k", F.col("a")).alias("a")).collect()
    assert all(int(values[0]) in r.a and len(r.a) < 3 for r in kept)
    assert rows.where(may_be_wanted(wanted.limit(0), "k", F.col("k"))).count() == 0
