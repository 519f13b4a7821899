"""Near-duplicate vectors by the epsilon grid order join.

Vectors of unit length whose cosine is c lie at distance sqrt(2 - 2c), so links are pairs within a distance
epsilon. Vectors are turned into their principal directions and sorted by the cells of a grid of width
epsilon over the leading ones. The sorted sequence is cut into blocks, eight neighbouring blocks into an interval,
eight intervals into the next, up to one. The join goes down this ladder from the pair of the whole with itself: a round
replaces each pair of intervals by the pairs of their parts and drops those whose boxes are further apart than
epsilon. Pairs of blocks that are left go on in one task each, which halves the longer side in turn and skips
what is provably too far until pieces are small; these are compared by their cosines. The bounds only
skip, so no link is lost, whatever the data look like; where little can be skipped, more is compared.

Equal vectors are one point with a number of copies. Each block is first joined with itself and its own
clusters are named; pairs of different blocks then give edges between such clusters only, however many links
they hold. Numbers of links are summed per point. No pair of vectors leaves a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from tripledger.llm.common import is_sound, ranked, stored
from tripledger.llm.components import components, forest

#: Points of a block, and of a piece that is compared without further halving.
BLOCK = 4096
PIECE = 128
#: Leading principal directions that give cells and boxes; the length of the rest is one more side of a box.
LEADING = 8
#: Parts of an interval.
PARTS = 8
#: Bounds skip only beyond epsilon and this: far more than rounding, far less than any data's grain.
SLACK = 1e-7

_SIDES = [f"y{k}" for k in range(LEADING + 1)]


def points(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """(rows: ``vec_id``, ``k``, ``l``: identity of the vector, null if it takes no part; points: ``point``, ``dim``, ``copies``,
    ``k``, ``l``, ``v``, one for each distinct vector that takes part). Both stored."""
    kind = vectors.schema[vector].dataType
    single = isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType)
    v = F.col(f"`{vector}`").cast(f"array<{'float' if single else 'double'}>")
    sound = F.col("vec_id").isNotNull() & is_sound(F.col("v")) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col(f"`{key}`").cast("long").alias("vec_id"), v.alias("v"))
    rows = rows.withColumn("v", F.when(F.coalesce(sound, F.lit(False)), F.col("v")))
    rows = rows.withColumns({"k": F.xxhash64("v"), "l": F.xxhash64(F.lit(1), "v", F.size("v"))})
    distinct = rows.where("v is not null").groupBy("k", "l", "v").agg(F.count("*").alias("copies"))
    distinct = distinct.withColumns({"point": F.monotonically_increasing_id(), "dim": F.size("v")})
    known = F.col("v").isNotNull()
    rows = rows.select("vec_id", F.when(known, F.col("k")).alias("k"), F.when(known, F.col("l")).alias("l"))
    return stored(rows, "vectors"), stored(distinct, "points")


def units(vectors: np.ndarray) -> np.ndarray:
    """The vectors at length 1; their largest component is taken out first, so that squares stay in range."""
    vectors = vectors.astype(np.float64)
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors**2).sum(axis=1, keepdims=True))


def _matrix(rows: pd.Series) -> np.ndarray:
    return np.stack(rows.to_numpy())


def principal(found: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per length of vector the mean and the principal directions (columns, leading first) of all its points.

    Tasks add up products and Spark the tasks' sums, so ``dim`` * ``dim`` numbers for each length reach the driver.
    """

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, some in batch.groupby("dim"):
                u = units(_matrix(some["v"]))
                u = np.hstack([u, np.ones((len(u), 1))])
                sums[dim] = sums.get(dim, 0) + u.T @ u
        for dim, total in sums.items():
            yield pd.DataFrame({"dim": dim, "at": np.arange(total.size), "total": total.ravel()})

    totals = found.select("dim", "v").mapInPandas(add, "dim int, at int, total double")
    out = {}
    for dim, some in totals.groupBy("dim", "at").agg(F.sum("total").alias("total")).toPandas().groupby("dim"):
        matrix = np.empty((dim + 1) ** 2)
        matrix[some["at"].to_numpy()] = some["total"].to_numpy()
        matrix = matrix.reshape(dim + 1, dim + 1)
        n = matrix[-1, -1]
        mean = matrix[-1, :-1] / n
        _, directions = np.linalg.eigh(matrix[:-1, :-1] / n - np.outer(mean, mean))
        out[int(dim)] = (mean, directions[:, ::-1])
    return out


def _in_order(found: DataFrame, epsilon: float) -> DataFrame:
    """The points with the block they fall into and their place along the sides of boxes; stored."""
    bases = principal(found)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, some in batch.groupby("dim"):
                mean, directions = bases[dim]
                y = (units(_matrix(some["v"])) - mean) @ directions
                lead = np.zeros((len(y), LEADING))
                lead[:, : min(dim, LEADING)] = y[:, :LEADING]
                some = some.assign(cells=list(np.floor(lead / epsilon).astype(np.int64)))
                some = some.assign(**{f"y{k}": lead[:, k] for k in range(LEADING)})
                yield some.assign(**{f"y{LEADING}": np.sqrt((y[:, LEADING:] ** 2).sum(axis=1))})

    kind = found.schema["v"].dataType.simpleString()
    schema = f"dim int, point long, copies long, v {kind}, cells array<long>, {', '.join(f'{s} double' for s in _SIDES)}"
    placed = found.select("dim", "point", "copies", "v").mapInPandas(place, schema)
    placed = ranked(stored(placed, "cells"), ["dim"], ["cells", "y0", "point"], ["dim", "point", "copies", "v", *_SIDES])
    return stored(placed.withColumn("block", F.floor(F.col("rank") / BLOCK)).drop("rank", "part"), "grid-order")


def _gap(limit: float) -> Column:
    """Whether the boxes ``a`` and ``b`` may hold points within the limit of each other."""
    total = F.lit(0.0)
    for s in _SIDES:
        apart = F.greatest(F.col(f"a.low_{s}") - F.col(f"b.high_{s}"), F.col(f"b.low_{s}") - F.col(f"a.high_{s}"), F.lit(0.0))
        total = total + apart * apart
    return total <= limit * limit


def block_pairs(order: DataFrame, epsilon: float) -> DataFrame:
    """(``dim``, ``a``, ``b``), a <= b: the pairs of blocks that may hold linked points, from the whole downwards."""
    boxes = [c for s in _SIDES for c in (F.min(s).alias(f"low_{s}"), F.max(s).alias(f"high_{s}"))]
    ladder = [stored(order.groupBy("dim", "block").agg(*boxes), "boxes")]
    boxes = [c for s in _SIDES for c in (F.min(f"low_{s}").alias(f"low_{s}"), F.max(f"high_{s}").alias(f"high_{s}"))]
    while not ladder[-1].where("block > 0").isEmpty():
        above = F.floor(F.col("block") / PARTS).alias("block")
        ladder.append(stored(ladder[-1].groupBy("dim", above).agg(*boxes), "boxes"))
    pairs = ladder[-1].select("dim", F.col("block").alias("a"), F.col("block").alias("b"))
    part = F.sequence(F.lit(0), F.lit(PARTS - 1))
    for level in reversed(ladder[:-1]):
        # At most PARTS * PARTS pairs from one; those that do not exist or are too far apart go in the joins.
        parts = pairs.withColumn("i", F.explode(part)).withColumn("j", F.explode(part))
        parts = parts.select("dim", (F.col("a") * PARTS + F.col("i")).alias("x"), (F.col("b") * PARTS + F.col("j")).alias("y"))
        parts = parts.where("x <= y").alias("p")
        parts = parts.join(level.alias("a"), (F.col("p.dim") == F.col("a.dim")) & (F.col("p.x") == F.col("a.block")))
        parts = parts.join(level.alias("b"), (F.col("p.dim") == F.col("b.dim")) & (F.col("p.y") == F.col("b.block")))
        pairs = parts.where(_gap(epsilon + SLACK)).select("p.dim", F.col("x").alias("a"), F.col("y").alias("b"))
        pairs = stored(pairs, "block-pairs")
    return pairs


def linked(a: np.ndarray, b: np.ndarray, y: np.ndarray, z: np.ndarray, least: float, epsilon: float) -> np.ndarray:
    """Which of the vectors ``a`` have which of ``b`` at a cosine of ``least`` or more. ``y``, ``z``: their coordinates."""
    u, w = a.astype(np.float64), b.astype(np.float64)
    u, w = u / np.abs(u).max(axis=1, keepdims=True), w / np.abs(w).max(axis=1, keepdims=True)
    p, q = np.sqrt((u**2).sum(axis=1)), np.sqrt((w**2).sum(axis=1))
    out = np.zeros((len(a), len(b)), bool)
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, l = todo.pop()
        left, right = y[i:j], z[k:l]
        apart = np.maximum(np.maximum(left.min(axis=0) - right.max(axis=0), right.min(axis=0) - left.max(axis=0)), 0)
        if apart @ apart > (epsilon + SLACK) ** 2:
            continue
        if max(j - i, l - k) <= PIECE:
            out[i:j, k:l] = (u[i:j] @ w[k:l].T) / (p[i:j, None] * q[None, k:l]) >= least
        elif j - i >= l - k:
            middle = (i + j) // 2
            todo += [(i, middle, k, l), (middle, j, k, l)]
        else:
            middle = (k + l) // 2
            todo += [(i, j, k, middle), (i, j, middle, l)]
    return out


def _sides_of(group: pd.DataFrame) -> np.ndarray:
    return group[_SIDES].to_numpy()


def point_links(order: DataFrame, least: float, epsilon: float) -> tuple[DataFrame, DataFrame]:
    """(``point``, ``links``: of rows of other points, ``label``: its cluster within its block) of all points; and edges
    (``u``, ``v``) between such clusters. Both stored."""

    def within(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["y0", "point"])
        ids, v, y = group["point"].to_numpy(), _matrix(group["v"]), _sides_of(group)
        near = linked(v, v, y, y, least, epsilon)
        np.fill_diagonal(near, False)
        links = near @ group["copies"].to_numpy()
        np.fill_diagonal(near, True)
        label = np.arange(len(ids))
        for root, other in forest(near, np.arange(len(ids)), np.arange(len(ids))):
            label[other] = root  # every edge of a forest names its root
        return pd.DataFrame({"point": ids, "links": links, "label": ids[label]})

    own = stored(order.groupBy("dim", "block").applyInPandas(within, "point long, links long, label long"), "own-links")
    pairs = block_pairs(order, epsilon).where("a < b")
    sides = pairs.select("dim", "a", "b", F.col("a").alias("block"), F.lit(0).alias("side")).unionByName(
        pairs.select("dim", "a", "b", F.col("b").alias("block"), F.lit(1).alias("side"))
    )
    named = order.join(own.select("point", "label"), "point")

    def across(group: pd.DataFrame) -> pd.DataFrame:
        left, right = (group[group["side"] == s].sort_values(["y0", "point"]) for s in (0, 1))
        near = linked(_matrix(left["v"]), _matrix(right["v"]), _sides_of(left), _sides_of(right), least, epsilon)
        i, j = near.any(axis=1), near.any(axis=0)
        counts = pd.concat([
            pd.DataFrame({"u": left["point"][i], "links": near[i] @ right["copies"].to_numpy()}),
            pd.DataFrame({"u": right["point"][j], "links": near[:, j].T @ left["copies"].to_numpy()}),
        ])
        # One row and one column for each cluster that links at all.
        a, x = np.unique(left["label"].to_numpy()[i], return_inverse=True)
        b, z = np.unique(right["label"].to_numpy()[j], return_inverse=True)
        met = np.zeros((len(a), len(b)), bool)
        at, to = np.nonzero(near[i][:, j])
        met[x[at], z[to]] = True
        edges = pd.DataFrame(forest(met, a, b), columns=["u", "v"], dtype="int64")
        return pd.concat([counts.assign(v=None), edges.assign(links=0)])[["u", "v", "links"]].astype({"v": "Int64"})

    met = named.join(sides, ["dim", "block"]).groupBy("dim", "a", "b").applyInPandas(across, "u long, v long, links long")
    met = stored(met, "block-links")
    more = met.where("v is null").groupBy(F.col("u").alias("point")).agg(F.sum("links").alias("more"))
    both = own.join(more, "point", "left").select("point", "label", (F.col("links") + F.coalesce("more", F.lit(0))).alias("links"))
    return stored(both, "links"), met.where("v is not null").select("u", "v")


def near_vectors(vectors: DataFrame, least: float = 0.95, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Per row: ``vec_id``, ``n_links`` (other rows linked directly), ``component_id`` (smallest id reachable), ``kept`` (whether
    it is the row's own).

    Rows link at a cosine of ``least`` (above 0) or more, in double precision; vectors of different lengths never do. A vector that is
    null, empty, zero or holds null or non-finite components links with nothing, and so does a row without
    id, whose component is null and which is kept. Repeated rows are each returned, and link with each other. Further
    columns are not looked at; an empty table gives no rows.
    """
    rows, distinct = points(vectors, key, vector)
    epsilon = float(np.sqrt(max(2 - 2 * least, 0.0))) or SLACK
    order = _in_order(distinct, epsilon)
    links, edges = point_links(order, least, epsilon)
    merged = components(edges).select(F.col("node").alias("label"), F.col("label").alias("cluster"))
    links = links.join(merged, "label", "left").select("point", "links", F.coalesce("cluster", "label").alias("cluster"))
    links = distinct.select("k", "l", "point", "copies").join(links, "point")
    rows = rows.join(stored(links, "clusters").drop("point"), ["k", "l"], "left")
    rows = stored(rows.select("vec_id", "cluster", (F.col("links") + F.col("copies") - 1).alias("n_links")), "linked")
    first = rows.where("cluster is not null").groupBy("cluster").agg(F.min("vec_id").alias("first"))
    rows = rows.join(stored(first, "first"), "cluster", "left").withColumn("component_id", F.coalesce("first", "vec_id"))
    return rows.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id",
        F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"),
    )
