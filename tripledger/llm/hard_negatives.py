"""Hard negatives by lists that clustered anchors share.

Anchors are clustered by direction. For a cluster with centre c, whose anchors are at most an angle w away from
it, the inner product of any of its anchors u with a vector i is at most |u| |i| cos(max(0, angle(i, c) - w)).
All vectors are sorted by that bound (without |u|) once for each cluster, and every anchor of the cluster
walks the one list from its head: as soon as |u| times the bound of what lies ahead cannot reach what it has
or looks for, its answer is certified and it stops. An anchor that bounds do not help walks its list
to the end, so answers are exact whatever the data.

An anchor walks twice: for its positives, the first others of its own label, and, knowing them, for the first
vectors of other labels whose score lies in each positive's window. A walk takes the list in segments,
a growing number in each round. In a round every group of up to ``GROUP`` open anchors of a cluster meets each of the
round's segments in a task of bounded size; what was found is merged per anchor, and certified anchors drop out.

Scores are exact integers: components are scaled and floored first. Ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripledger.llm.common import is_sound, ranked, stored

#: Vectors of a segment; anchors that meet one in a task; by how much the segments of a round grow.
SEGMENT = 2048
GROUP = 1024
GROWTH = 4
#: Widens bounds beyond any rounding.
SLACK = 1e-9
_NONE = np.iinfo(np.int64).min


@dataclass(frozen=True)
class Mining:
    """``clusters`` are fitted on at most ``sample`` anchors, drawn by hash; every anchor and vector is then assigned."""

    scale: int = 256
    anchor_every: int = 50
    positives: int = 5
    negatives: int = 3
    low: int = 50  # percent of the positive's score
    high: int = 95
    clusters: int = 8
    sample: int = 4096
    steps: int = 8


def quantised(vectors: DataFrame, scale: int, label: Column) -> DataFrame:
    """(``row``, ``vec_id``, ``label``, ``dim``, ``v`` = floor(scale * component)), stored; ``row`` tells repeated ids apart.

    Rows with a null id, label or vector, an empty vector, or a null or non-finite component take no part.
    """
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"),
        F.col("embedding").cast("array<double>").alias("e"),
    )
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("e").isNotNull()).where(is_sound(F.col("e")))
    scaled = F.transform("e", lambda x: F.floor(x * F.lit(float(scale))).cast("long"))
    return stored(
        rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", F.size("e").alias("dim"), scaled.alias("v")),
        "points",
    )


# ---------------------------------------------------------------- clusters and their lists


def _matrix(rows: pd.Series, kind=np.int64) -> np.ndarray:
    return np.stack(rows.to_numpy()).astype(kind)


def _norms(points: np.ndarray) -> np.ndarray:
    return np.sqrt((points.astype(np.float64) ** 2).sum(axis=1))


def _angles(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Angle of each point with each centre of length 1; a right angle for a zero vector, whose bound is 0 anyway."""
    lengths = _norms(points)
    cosines = (points.astype(np.float64) @ centres.T) / np.where(lengths > 0, lengths, 1)[:, None]
    return np.arccos(np.clip(cosines, -1, 1))


def centres_of(anchors: np.ndarray, clusters: int, steps: int) -> np.ndarray:
    """Spherical k-means from anchors far apart; rows of length 1."""
    lengths = _norms(anchors)
    u = anchors[lengths > 0] / lengths[lengths > 0][:, None]
    if not len(u):
        return np.eye(1, anchors.shape[1])
    chosen = [0]
    near = u @ u[0]
    while len(chosen) < clusters and near.min() < 1 - SLACK:
        chosen.append(int(near.argmin()))
        near = np.maximum(near, u @ u[chosen[-1]])
    centres = u[chosen]
    for _ in range(steps):
        home = (u @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, u)
        lengths = _norms(sums)
        centres = np.where(lengths[:, None] > SLACK, sums / np.maximum(lengths, SLACK)[:, None], centres)
    return centres


def clusters_of(anchors: DataFrame, m: Mining) -> dict[int, tuple[int, np.ndarray]]:
    """Per length of vector its centres, and the number of the first of them."""
    sample = anchors.orderBy(F.xxhash64("vec_id"), "row").limit(m.sample).select("dim", "v").toPandas()
    out, first = {}, 0
    # A length that the sample has not met gets one centre when its anchors are assigned.
    dims = sorted(r[0] for r in anchors.select("dim").distinct().collect())
    for dim in dims:
        some = sample[sample["dim"] == dim]["v"]
        centres = centres_of(_matrix(some), m.clusters, m.steps) if len(some) else np.eye(1, dim)
        out[dim] = (first, centres)
        first += len(centres)
    return out


def assigned(anchors: DataFrame, centres: dict[int, tuple[int, np.ndarray]]) -> DataFrame:
    """The anchors with ``cluster``, ``angle`` to its centre and ``norm``; stored."""

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, some in batch.groupby("dim"):
                first, c = centres[dim]
                points = _matrix(some["v"])
                angles = _angles(points, c)
                best = angles.argmin(axis=1)
                yield some.assign(cluster=first + best, angle=angles[np.arange(len(best)), best], norm=_norms(points))

    schema = "row long, vec_id long, label long, dim int, v array<long>, cluster int, angle double, norm double"
    return stored(anchors.select("row", "vec_id", "label", "dim", "v").mapInPandas(assign, schema), "anchors")


def shared_lists(points: DataFrame, anchors: DataFrame, centres: dict[int, tuple[int, np.ndarray]]) -> DataFrame:
    """Per cluster that has anchors all vectors of its length: ``cluster``, ``segment`` (from 0, by falling ``bound``),
    ``bound``, ``row``, ``vec_id``, ``label``, ``v``; stored."""
    widest = {r[0]: r[1] for r in anchors.groupBy("cluster").agg(F.max("angle")).collect()}

    def bound(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, some in batch.groupby("dim"):
                if dim not in centres:
                    continue
                first, c = centres[dim]
                points = _matrix(some["v"])
                angles, lengths = _angles(points, c), _norms(points)
                for k in range(len(c)):
                    if first + k in widest:
                        least = np.maximum(angles[:, k] - widest[first + k] - SLACK, 0)
                        yield some.drop(columns="dim").assign(cluster=first + k, bound=lengths * (np.cos(least) + SLACK))

    schema = "row long, vec_id long, label long, v array<long>, cluster int, bound double"
    listed = points.select("row", "vec_id", "label", "dim", "v").mapInPandas(bound, schema)
    keep = ["cluster", "bound", "row", "vec_id", "label", "v"]
    listed = ranked(listed, ["cluster"], [F.col("bound").desc(), "vec_id", "row"], keep)
    return stored(listed.withColumn("segment", F.floor(F.col("rank") / SEGMENT)).drop("rank", "part"), "lists")


# ---------------------------------------------------------------- walks


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers (beyond 64 bits they wrap)."""
    largest = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if largest < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _first(scores: np.ndarray, ids: np.ndarray, able: np.ndarray, n: int, least: int) -> np.ndarray:
    """Places of the ``n`` highest of the able scores, if they reach ``least``; ties by id."""
    at = np.flatnonzero(able & (scores >= least))
    if len(at) > n:
        some = scores[at]
        at = at[some >= np.partition(some, len(some) - n)[len(some) - n]]
    return at[np.lexsort((ids[at], -scores[at]))[:n]]


def _met(anchors: DataFrame, lists: DataFrame, begin: int, end: int, found: Callable) -> DataFrame:
    """``found`` (anchor rows, list rows, their scores) for every group of open anchors and segment of the round."""
    sizes = anchors.groupBy("cluster").agg(F.ceil(F.count("*") / GROUP).alias("groups"))
    sizes = stored(sizes, "groups")  # a row per cluster
    group = F.pmod(F.xxhash64("row"), F.col("groups")).alias("grp")
    reach = lists.where((F.col("segment") >= begin) & (F.col("segment") < end))
    segments = reach.select("cluster", "segment").distinct()
    shared = ["cluster", "grp", "segment", "row", "vec_id", "label", "v"]
    left = anchors.join(sizes, "cluster").select("*", group).join(segments, "cluster")
    left = left.select(*shared, "wanted", F.lit(True).alias("anchor"))
    right = reach.join(sizes, "cluster").withColumn("grp", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)))
    right = right.select(*shared, F.array().cast("array<long>").alias("wanted"), F.lit(False).alias("anchor"))

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        ours, theirs = rows[rows["anchor"]], rows[~rows["anchor"]]
        out = []
        if len(ours) and len(theirs):
            scores = products(_matrix(ours["v"]), _matrix(theirs["v"]))
            ids, labels, own = (theirs[c].to_numpy() for c in ("vec_id", "label", "row"))
            for k, (row, label, wanted) in enumerate(zip(ours["row"].tolist(), ours["label"].tolist(), ours["wanted"], strict=True)):
                for place, at in found(scores[k], ids, labels == label, own == row, wanted):
                    out += [(row, place, int(ids[j]), int(scores[k][j])) for j in at]
        return pd.DataFrame(out, columns=["anchor", "place", "vec_id", "score"], dtype="int64")

    return left.unionByName(right).groupBy("cluster", "grp", "segment").applyInPandas(
        meet, "anchor long, place int, vec_id long, score long"
    )


def _walk(anchors: DataFrame, lists: DataFrame, most: int, wanted: Callable, found: Callable, open_: Callable) -> DataFrame:
    """(``anchor``, ``place``, ``rank``, ``vec_id``, ``score``): the ``most`` best of each place that the walk finds.

    ``wanted`` (anchors with what they have, ``have``: map of place to the ``most``-th score) gives the numbers that go with an
    anchor; ``open_`` (``have``, ``ahead``: what the rest of its list can reach at most) whether it must go on.
    """
    heads = stored(lists.groupBy("cluster", "segment").agg(F.max("bound").alias("bound")), "heads")
    order = Window.partitionBy("anchor", "place").orderBy(F.col("score").desc(), "vec_id")
    spark = anchors.sparkSession
    best = spark.createDataFrame([], "anchor long, place int, vec_id long, score long, rank int")
    nothing = F.create_map().cast("map<int,bigint>")
    walking = anchors.withColumn("have", nothing)
    begin, end = 0, 1
    while True:
        new = _met(walking.withColumn("wanted", wanted(F.col("have"))), lists, begin, end, found)
        best = best.drop("rank").unionByName(new).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
        best = stored(best, "best")
        full = best.where(F.col("rank") == most).groupBy(F.col("anchor").alias("row")).agg(
            F.map_from_entries(F.collect_list(F.struct("place", "score"))).alias("have")
        )
        ahead = heads.where(F.col("segment") == end).select("cluster", "bound")
        # No segment ahead: the list is at its end, and whoever is left is certified.
        walking = walking.drop("have").join(ahead, "cluster").withColumn("ahead", F.col("norm") * F.col("bound"))
        walking = walking.join(full, "row", "left").withColumn("have", F.coalesce("have", nothing))
        walking = stored(walking.where(open_(F.col("have"), F.col("ahead"))).drop("ahead", "bound"), "walking")
        if walking.isEmpty():
            return best
        begin, end = end, end + GROWTH * (end - begin)


def hard_negatives(vectors: DataFrame, label: Column | None = None, m: Mining = Mining()) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``.

    Anchors are the rows whose ``vec_id`` is divisible by ``anchor_every``. An anchor's positives are its highest-scored other
    rows of its label; a positive's negatives the highest-scored rows of other labels with a score of
    ``low`` to ``high`` percent of the positive's (none if that is negative). Fewer give fewer rows. ``label`` defaults to the column of that
    name. Vectors meet vectors of the same length only. Every row of a repeated id is a vector of its own, and an anchor
    of its own; an empty table gives no rows, further columns are not looked at.
    """
    points = quantised(vectors, m.scale, F.col("label") if label is None else label)
    anchors = points.where(F.col("vec_id") % m.anchor_every == 0)
    centres = clusters_of(anchors, m)
    anchors = assigned(anchors, centres)
    lists = shared_lists(points, anchors, centres)

    def alike(scores, ids, same, own, wanted):
        yield 0, _first(scores, ids, same & ~own, m.positives, wanted[0])

    none = F.lit(int(_NONE))
    positives = _walk(
        anchors, lists, m.positives,
        lambda have: F.array(F.coalesce(have[0], none)),
        alike,
        lambda have, ahead: F.coalesce(have[0] <= ahead, F.lit(True)),
    )
    positives = positives.select("anchor", F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    able = positives.where("positive_score >= 0")
    targets = able.groupBy(F.col("anchor").alias("row")).agg(
        F.array_sort(F.collect_list(F.struct("place", F.col("positive_score").alias("score")))).alias("targets")
    )
    searching = stored(anchors.join(targets, "row"), "searching")

    def unlike(scores, ids, same, own, wanted):
        hundred = 100 * scores
        for place, goal, least in wanted.reshape(-1, 3).tolist():
            able = ~same & (hundred >= m.low * goal) & (hundred <= m.high * goal)
            yield place, _first(scores, ids, able, m.negatives, least)

    negatives = _walk(
        searching, lists, m.negatives,
        lambda have: F.flatten(F.transform("targets", lambda t: F.array(t["place"].cast("long"), t["score"], F.coalesce(have[t["place"]], none)))),
        unlike,
        # A target is open while what lies ahead may reach its window and what it has.
        lambda have, ahead: F.exists("targets", lambda t: (ahead * 100 >= t["score"] * m.low) & F.coalesce(have[t["place"]] <= ahead, F.lit(True))),
    )
    ids = anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return negatives.select("anchor", "place", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).join(
        positives, ["anchor", "place"]
    ).join(ids, "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
