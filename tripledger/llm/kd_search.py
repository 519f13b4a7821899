"""Exact top-k search by inner product with a KD-tree per shard.

Vectors are dealt by hash of their id into shards of bounded size. Each shard becomes a tree: nodes are
halved at the median of their widest dimension and keep the tight box of their points. Trees are
written once below the shared folder.

A task takes a block of queries and a lane of shards. For every query it walks each tree best first: a box
bounds the inner product by the better of its two sides in every dimension, and the walk ends as soon as
no open box can reach the k-th best score. That score goes along from shard to shard, so later trees
are cut short by what earlier ones gave. Lanes are merged per query at the end. Memory is bounded by one
tree and one block; all queries meet all shards, in blocks.

Scores are exact integers: components are scaled and floored first. Ties go to the smaller id.
"""

from __future__ import annotations

import io
import uuid
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripledger.llm.common import stored
from tripledger.session import work_folder

#: Points of a shard, of a leaf; queries of a block; lanes that a block's shards are dealt to.
SHARD = 16_384
LEAF = 128
BLOCK = 256
LANES = 8


def quantised(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """(``row``, ``vec_id``, ``dim``, ``v``) with ``v`` = floor(scale * component), stored; ``row`` tells repeated ids apart.

    Rows with a null id or vector, an empty vector, or a null or non-finite component take no part.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    sound = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & (F.size("e") > 0)).where(F.coalesce(sound, F.lit(False)))
    rows = rows.select("vec_id", F.transform("e", lambda x: F.floor(x * F.lit(float(scale))).cast("long")).alias("v"))
    return stored(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", F.size("v").alias("dim"), "v"), "points")


# ---------------------------------------------------------------- one tree


class Tree:
    """Points in leaf order; nodes with box, children (0: leaf) and the range of their points."""

    def __init__(self, ids, points, low, high, child, begin, end):
        self.ids, self.points, self.low, self.high = ids, points, low, high
        self.child, self.begin, self.end = child, begin, end

    @classmethod
    def build(cls, ids: np.ndarray, points: np.ndarray, leaf: int = LEAF) -> Tree:
        order = np.arange(len(ids))
        low, high, child, begin, end = [], [], [], [], []

        def node(a: int, b: int) -> int:
            some = points[order[a:b]]
            low.append(some.min(axis=0))
            high.append(some.max(axis=0))
            child.append(0)
            begin.append(a)
            end.append(b)
            return len(child) - 1

        todo = [node(0, len(ids))]
        while todo:
            k = todo.pop()
            a, b = begin[k], end[k]
            if b - a <= leaf:
                continue
            widest = int(np.argmax(high[k] - low[k]))
            middle = (a + b) // 2
            part = np.argpartition(points[order[a:b], widest], middle - a)
            order[a:b] = order[a:b][part]
            child[k] = node(a, middle)
            node(middle, b)  # the right child follows the left one
            todo += [child[k], child[k] + 1]
        return cls(ids[order], points[order], np.array(low), np.array(high), np.array(child), np.array(begin), np.array(end))

    def save(self, out) -> None:
        np.savez(out, **{k: getattr(self, k) for k in ("ids", "points", "low", "high", "child", "begin", "end")})

    @classmethod
    def load(cls, source) -> Tree:
        with np.load(source) as found:
            return cls(**{k: found[k] for k in found.files})


class Best:
    """The k best of one query so far: highest score first, then smallest id."""

    def __init__(self, k: int):
        self.k = k
        self.scores, self.ids = np.empty(0, np.int64), np.empty(0, np.int64)
        self.least = None  # the k-th score, once there are k

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if self.least is not None:
            able = scores >= self.least
            if not able.any():
                return
            scores, ids = scores[able], ids[able]
        scores, ids = np.concatenate((self.scores, scores)), np.concatenate((self.ids, ids))
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]
        if len(order) == self.k:
            self.least = int(self.scores[-1])


def search(tree: Tree, ids: np.ndarray, queries: np.ndarray, best: list[Best]) -> int:
    """Brings each query's best up to date with the tree; gives the number of leaves looked at."""
    largest = float(np.abs(queries).max(initial=0)) * float(np.abs(tree.points).max(initial=0)) * queries.shape[1]
    kind = np.float64 if largest < 2.0**53 else np.int64  # floating-point products of small integers are exact
    q, points = queries.astype(kind), tree.points.astype(kind)
    bounds = np.maximum(q, 0) @ tree.high.T.astype(kind) + np.minimum(q, 0) @ tree.low.T.astype(kind)
    child, begin, end = tree.child.tolist(), tree.begin.tolist(), tree.end.tolist()
    looked = 0
    for k, own in enumerate(ids.tolist()):
        found, bound, query = best[k], bounds[k].tolist(), q[k]
        heap = [(-bound[0], 0)]
        while heap:
            worst, node = heappop(heap)
            if found.least is not None and -worst < found.least:
                break
            if child[node]:
                for c in (child[node], child[node] + 1):
                    if found.least is None or bound[c] >= found.least:
                        heappush(heap, (-bound[c], c))
                continue
            looked += 1
            a, b = begin[node], end[node]
            scores, names = (points[a:b] @ query).astype(np.int64), tree.ids[a:b]
            other = names != own
            if not other.all():
                scores, names = scores[other], names[other]
            found.add(scores, names)
    return looked


# ---------------------------------------------------------------- Spark


def _file(url: str, data: bytes | None = None) -> bytes:
    """Reads a file; or writes it under a name of the attempt and moves it, equal content, into place."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(url)
    if data is None:
        with system.open_input_file(path) as source:
            return source.read()
    made = f"{path}.{uuid.uuid4().hex}"
    with system.open_output_stream(made, compression=None) as out:
        out.write(data)
    try:
        system.move(made, path)
    except OSError:
        if system.get_file_info(path).type == fs.FileType.NotFound:
            raise
        system.delete_file(made)  # another attempt was first
    return data


def top_k(vectors: DataFrame, k: int = 20, query_every: int = 20, scale: int = 64, shard: int = SHARD) -> DataFrame:
    """For every vector whose id is divisible by ``query_every`` the k best others, ranks from 1.

    Vectors meet vectors of the same length only. Every row of a repeated id is a candidate; an id's own rows are none of
    its candidates, and its queries share one list of k. Fewer others than k give fewer rows, none give none;
    sums beyond 64 bits wrap. An empty table gives no rows; other columns are not looked at.
    """
    points = quantised(vectors, scale)
    folder = work_folder(points.sparkSession, "trees")
    # One row per length of vector.
    sizes = points.groupBy("dim").agg(
        F.ceil(F.count("*") / shard).cast("int").alias("shards"),
        F.ceil(F.count_if(F.col("vec_id") % query_every == 0) / BLOCK).cast("int").alias("blocks"),
    )
    sizes = stored(sizes, "sizes")
    groups = sizes.agg(F.sum("shards"), F.sum(F.col("blocks") * F.least("shards", F.lit(LANES)))).first()
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Few rows and much work: the number of tasks is given, so that Spark doesn't fold them into one.
    builders, walkers = (max(1, min(int(n or 0), 4 * tasks)) for n in groups)
    sizes = F.broadcast(sizes)

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        Tree.build(rows["vec_id"].to_numpy(np.int64), np.array(rows["v"].tolist(), np.int64)).save(out)
        _file(f"{folder}/{key[0]}-{key[1]}.npz", out.getvalue())
        return pd.DataFrame({"shard": [int(key[1])], "points": [len(rows)]})

    dealt = points.join(sizes, "dim").withColumn("shard", F.pmod(F.xxhash64("row"), F.col("shards")).cast("int"))
    dealt = dealt.repartition(builders, "dim", "shard")
    stored(dealt.groupBy("dim", "shard").applyInPandas(build, "shard int, points long"), "forest")

    def walk(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        dim, _, lane = (int(x) for x in key)
        ids, queries = rows["vec_id"].to_numpy(np.int64), np.array(rows["v"].tolist(), np.int64)
        best = [Best(k) for _ in ids]
        for number in range(lane, int(rows["shards"].iloc[0]), LANES):
            search(Tree.load(io.BytesIO(_file(f"{folder}/{dim}-{number}.npz"))), ids, queries, best)
        return pd.DataFrame(
            {
                "query_id": np.repeat(ids, [len(b.ids) for b in best]),
                "vec_id": np.concatenate([b.ids for b in best]),
                "score": np.concatenate([b.scores for b in best]),
            }
        )

    queries = points.where(F.col("vec_id") % query_every == 0).join(sizes, "dim")
    lanes = F.sequence(F.lit(0), F.least("shards", F.lit(LANES)) - 1)
    queries = queries.withColumn("block", F.pmod(F.xxhash64(F.col("row"), F.lit(1)), F.col("blocks")).cast("int"))
    queries = queries.withColumn("lane", F.explode(lanes)).select("dim", "block", "lane", "vec_id", "v", "shards")
    queries = queries.repartition(walkers, "dim", "block", "lane")
    found = queries.groupBy("dim", "block", "lane").applyInPandas(walk, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
