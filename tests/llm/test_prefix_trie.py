"""Tree contraction and the conversation trie against brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from corpus_helpers import extra
from pyspark.sql import functions as F

from tripledger.llm import prefix_trie
from tripledger.llm.contraction import subtree_totals

TREE = "node long, parent long, a long, b long"
TURNS = "conv_id long, turn long, role string, text string"


def brute_totals(rows):
    children = defaultdict(list)
    for node, parent, *_ in rows:
        children[parent].append(node)
    own = {node: (a or 0, b or 0) for node, _, a, b in rows}
    out = {}

    def walk(root):
        todo, seen = [root], []
        while todo:
            node = todo.pop()
            seen.append(node)
            todo += children[node]
        for node in reversed(seen):
            below = [out[c] for c in children[node]]
            out[node] = tuple(own[node][k] + sum(x[k] for x in below) for k in (0, 1))

    for root in children[None]:
        walk(root)
    return out


def random_tree(kind, n, seed):
    draw = random.Random(seed)
    parents = {
        "chain": lambda k: k - 1,
        "star": lambda k: 0,
        "random": lambda k: draw.randrange(k),
        "deep": lambda k: max(0, k - draw.randrange(1, 4)),
        "comb": lambda k: k - 1 if k % 2 else max(0, k - 2),
    }[kind]
    names = draw.sample(range(10 * n), n)
    return [(names[k], names[parents(k)] if k else None, draw.randrange(9), draw.choice([None, 1, 5])) for k in range(n)]


@pytest.mark.parametrize("kind", ["chain", "star", "random", "deep", "comb"])
def test_contraction_gives_every_subtree_total(spark, kind):
    rows = random_tree(kind, 150, 3)
    rows += [(node + 10**6, None if parent is None else parent + 10**6, a, b) for node, parent, a, b in random_tree("random", 20, 4)]
    found = subtree_totals(spark.createDataFrame(rows, TREE), ["a", "b"])
    assert {(r.node): (r.a, r.b) for r in found.collect()} == brute_totals(rows)


def test_contraction_without_nodes_and_with_a_ring(spark):
    assert subtree_totals(spark.createDataFrame([], TREE), ["a", "b"]).collect() == []
    ring = spark.createDataFrame([(1, 2, 1, 1), (2, 3, 1, 1), (3, 1, 1, 1), (4, 1, 1, 1)], TREE)
    with pytest.raises(ValueError, match="ring"):
        subtree_totals(ring, ["a"])


def brute_report(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - int(c - 20 * int(c / 20)), [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)

    def below(key):
        return [k for k in members if k[: len(key)] == key]

    out = set()
    for key, some in members.items():
        kids = [k for k in members if len(k) == len(key) + 1 and k[:-1] == key]
        leaves = saved = 0
        for k in below(key):
            leaves += not any(len(x) == len(k) + 1 and x[:-1] == k for x in members)
            saved += (len(members[k]) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0)
        ends = ",".join(str(c) for c in sorted(some) if len(built[c]) == len(key))
        out.add((
            min(some), len(key), min(members[key[:-1]]) if key else None, len(some), len(kids), leaves, saved,
            hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return out


def talk(seed, convs, phrases=3):
    draw = random.Random(seed)
    texts = [None, "", "one", "two  words", "some\nmore\twords here", "ünï cödé a b"] + [f"p{k}" for k in range(phrases)]
    rows = []
    for c in convs:
        for turn in range(draw.randrange(1, 6)):
            rows.append((c, draw.choice([None, turn, turn, 1]), draw.choice(["user", "user", None]), draw.choice(texts)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_equals_brute_force(spark, seed):
    rows = talk(seed, [*range(45), *range(81, 95), 1025, 1047, 2051, -3, -21]) + [(None, 1, "user", "lost")]
    rows += rows[:7]
    found = prefix_trie.report(extra(spark.createDataFrame(rows, TURNS)))
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute_report(rows)


def test_trie_of_copies_a_long_conversation_and_none(spark):
    rows = [(c, t, "user", f"word {t}") for c in range(4000, 4000 + 1500) for t in (1, 2)]
    rows += [(40, t, "user", f"a b {t}") for t in range(60)] + [(41, 1, "user", "x" * 200_000 + " y")]
    whole = prefix_trie.report(spark.createDataFrame(rows, TURNS))
    assert {tuple(r) for r in whole.collect()} == brute_report(rows)
    assert prefix_trie.report(spark.createDataFrame([], TURNS)).collect() == []


def test_a_conversation_may_end_up_without_turns(spark):
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in range(1, 20)}
    c = next(c for c in h if h[c] > 0)
    rows = [(c, 1, "user", "goes")]
    assert {tuple(r) for r in prefix_trie.report(spark.createDataFrame(rows, TURNS)).collect()} == brute_report(rows)


def test_places_in_groups_of_any_size(spark, tmp_path):
    from tripledger.llm.common import ranked

    rows = [(0, k % 50) for k in range(3000)] + [(g, g) for g in range(1, 40)]
    spark.createDataFrame(rows, "g long, o long").repartition(7).write.parquet(str(tmp_path / "rows"))
    read = spark.read.parquet(str(tmp_path / "rows"))
    found = ranked(read, ["g"], [F.col("o").desc()], ["g", "o"]).orderBy("g", "rank").collect()
    assert [r.rank for r in found if r.g == 0] == list(range(3000))
    assert [r.o for r in found if r.g == 0] == sorted((o for g, o in rows if g == 0), reverse=True)
    assert [r.rank for r in found if r.g] == [0] * 39
