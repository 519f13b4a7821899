"""Hard negatives and near vectors against brute force."""

import numpy as np
import pytest
from corpus_helpers import extra
from pyspark.sql import functions as F

from tripledger.llm import grid_order, hard_negatives
from tripledger.llm.hard_negatives import Mining

VECTORS = "vec_id long, embedding array<float>, label int"
AWKWARD = [
    (3, None, 1), (4, [], 1), (6, [1.0, None], 1), (8, [float("nan"), 1.0], 1), (9, [float("inf"), 1.0], 2), (None, [1.0, 1.0], 1),
]


def sound(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v)


def brute_negatives(rows, m):
    points = []
    for vec_id, v, label in rows:
        if vec_id is not None and label is not None and sound(v):
            points.append((vec_id, label, [int(np.floor(m.scale * float(np.float32(x)))) for x in v]))
    out = []
    for a, (anchor, label, v) in enumerate(points):
        if anchor % m.anchor_every:
            continue
        scored = [
            (-sum(x * y for x, y in zip(v, w, strict=True)), other, kind)
            for b, (other, kind, w) in enumerate(points) if b != a and len(w) == len(v)
        ]
        scored.sort()
        for score, positive, _ in [x for x in scored if x[2] == label][: m.positives]:
            fit = [x for x in scored if x[2] != label and m.low * -score <= 100 * -x[0] <= m.high * -score]
            out += [(anchor, positive, k + 1, other, -score, -s) for k, (s, other, _) in enumerate(fit[: m.negatives])]
    return sorted(out)


def cloud(seed, n, dim, centres=4, spread=0.3):
    draw = np.random.default_rng(seed)
    middle = draw.standard_normal((centres, dim))
    which = draw.integers(0, centres, n)
    v = middle[which] + spread * draw.standard_normal((n, dim))
    v /= np.linalg.norm(v, axis=1)[:, None]
    return [(k, [float(x) for x in v[k]], int(which[k] + draw.integers(0, 2))) for k in range(n)]


@pytest.mark.parametrize(("seed", "dim", "segment", "clusters"), [(1, 6, 20, 3), (2, 2, 7, 8), (3, 12, 2048, 1)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, seed, dim, segment, clusters):
    monkeypatch.setattr(hard_negatives, "SEGMENT", segment)
    monkeypatch.setattr(hard_negatives, "GROUP", 4)
    m = Mining(scale=8, anchor_every=9, clusters=clusters)  # a coarse scale: many ties
    rows = cloud(seed, 240, dim) + [(18, [0.5] * dim, 1), (18, [0.5] * dim, 1), (18, [0.9] * dim, 2), (27, [0.0] * dim, 1)]
    rows += AWKWARD + [(36, [1.0, 2.0, 3.0], 1), (37, [1.0, 2.5, 3.0], 1), (38, [0.7, 1.7, 2.0], 5), (5, [0.1] * dim, None)]
    found = hard_negatives.hard_negatives(spark.createDataFrame(rows, VECTORS), m=m).collect()
    wanted = brute_negatives(rows, m)
    assert sorted(tuple(r) for r in found) == wanted
    assert len(wanted) > 50


def test_lists_are_left_early_where_bounds_help(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "SEGMENT", 50)
    seen = []
    meet = hard_negatives._met

    def spied(anchors, lists, begin, end, found):
        seen.append((begin, anchors.count()))
        return meet(anchors, lists, begin, end, found)

    monkeypatch.setattr(hard_negatives, "_met", spied)
    rows = cloud(5, 2000, 16, centres=10, spread=0.02)
    m = Mining(anchor_every=100, clusters=10)
    found = hard_negatives.hard_negatives(spark.createDataFrame(rows, VECTORS), m=m).collect()
    assert sorted(tuple(r) for r in found) == brute_negatives(rows, m)
    first_walk = [n for k, (begin, n) in enumerate(seen) if begin >= 21 and not any(b == 0 for b, _ in seen[1 : k + 1])]
    assert not first_walk or max(first_walk) < 20  # 40 segments each; most anchors stop before the 22nd


def test_hard_negatives_of_nothing_and_with_other_columns(spark):
    assert hard_negatives.hard_negatives(spark.createDataFrame([], VECTORS)).collect() == []
    rows = cloud(7, 120, 5)
    table = extra(spark.createDataFrame(rows, VECTORS).withColumnRenamed("label", "kind")).withColumn("label", F.col("kind"))
    found = hard_negatives.hard_negatives(table.withColumn("cluster", F.lit("x")), m=Mining(anchor_every=10))
    assert sorted(tuple(r) for r in found.collect()) == brute_negatives(rows, Mining(anchor_every=10))


def test_products_are_exact_beyond_floating_point():
    a = np.array([[2**40 + 1, 3]], np.int64)
    assert hard_negatives.products(a, a)[0, 0] == np.int64(((2**40 + 1) ** 2 + 9) & (2**63 - 1))


# ---------------------------------------------------------------- near vectors


def brute_near(rows, least):
    n = len(rows)
    able = [r[0] is not None and sound(r[1]) and any(x != 0 for x in r[1]) for r in rows]
    links = [set() for _ in rows]
    for a in range(n):
        for b in range(a):
            if able[a] and able[b] and len(rows[a][1]) == len(rows[b][1]):
                x, y = (np.array(rows[k][1], np.float32).astype(float) for k in (a, b))
                x, y = x / np.abs(x).max(), y / np.abs(y).max()
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                    links[a].add(b)
                    links[b].add(a)
    out, home = [], [None] * n
    for a in range(n):
        if home[a] is None:
            todo, some = [a], {a}
            while todo:
                for b in links[todo.pop()] - some:
                    some.add(b)
                    todo.append(b)
            for b in some:
                home[b] = min(rows[k][0] for k in some) if rows[a][0] is not None else None
        out.append((rows[a][0], len(links[a]), home[a], rows[a][0] is None or rows[a][0] == home[a]))
    return sorted(out, key=str)


def near_rows(seed, dim, n):
    draw = np.random.default_rng(seed)
    base = draw.standard_normal((n, dim))
    rows = [base[k] * draw.uniform(0.1, 9) for k in range(n)]
    rows += [base[k % 7] + 0.12 * draw.standard_normal(dim) for k in range(n)]  # families around the limit
    rows += [base[0] + 0.01 * draw.standard_normal(dim) for _ in range(n)]  # one dense family
    rows += [rows[3]] * 9 + [-rows[3], 2 * rows[3], rows[0] * 1e30, np.zeros(dim)]
    ids = draw.permutation(len(rows)).tolist()
    return [(int(k), [float(np.float32(x)) for x in v], 0) for k, v in zip(ids, rows, strict=True)]


@pytest.mark.parametrize(("seed", "dim", "n", "block"), [(1, 16, 60, 16), (2, 3, 50, 8), (3, 64, 40, 4096), (4, 1, 5, 4)])
def test_near_vectors_equal_brute_force(spark, monkeypatch, seed, dim, n, block):
    monkeypatch.setattr(grid_order, "BLOCK", block)
    monkeypatch.setattr(grid_order, "PIECE", 4)
    rows = near_rows(seed, dim, n) + AWKWARD + [(7, [1.0, 2.0], 0), (1000, [2.0, 4.0], 0), (1000, [5.0, -1.0], 0)]
    rows += [(10**6, [1.0] * 80, 0), (10**6 + 1, [1.0] * 79 + [1.1], 0)]
    found = grid_order.near_vectors(extra(spark.createDataFrame(rows, VECTORS)))
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute_near(rows, 0.95)


def test_near_vectors_of_nothing_and_of_none_that_links(spark):
    assert grid_order.near_vectors(spark.createDataFrame([], VECTORS)).collect() == []
    found = grid_order.near_vectors(spark.createDataFrame(AWKWARD, VECTORS)).collect()
    assert sorted((tuple(r) for r in found), key=str) == brute_near(AWKWARD, 0.95)


def test_distant_blocks_are_skipped(spark, monkeypatch):
    monkeypatch.setattr(grid_order, "BLOCK", 8)
    draw = np.random.default_rng(1)
    angle = draw.uniform(0, 2 * np.pi, 600)
    rows = [(k, [float(np.cos(x)), float(np.sin(x))], 0) for k, x in enumerate(angle)]
    _, found = grid_order.points(spark.createDataFrame(rows, VECTORS))
    pairs = grid_order.block_pairs(grid_order._in_order(found, 0.02), 0.02).count()
    assert pairs < 75 * 76 / 2 / 4
    whole = grid_order.near_vectors(spark.createDataFrame(rows[:200], VECTORS), 0.9998)
    assert sorted((tuple(r) for r in whole.collect()), key=str) == brute_near(rows[:200], 0.9998)


def test_double_vectors_keep_their_precision(spark):
    rows = [(1, [1.0, 0.0], 0), (2, [1.0, 1e-9], 0), (3, [1e200, 1e200], 0), (4, [1e-200, 1e-200], 0), (5, [-1.0, 0.0], 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = {r.vec_id: (r.n_links, r.component_id) for r in grid_order.near_vectors(table).collect()}
    assert found == {1: (1, 1), 2: (1, 1), 3: (1, 3), 4: (1, 3), 5: (0, 5)}
