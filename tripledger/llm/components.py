"""Connected components of an edge table by alternating large and small stars.

Every round hangs each node's larger neighbours, then its smaller ones, below the least node it sees,
until only stars are left. Rounds are written to the shared folder; a node with very many
neighbours is one row of minima and many rows that adaptive execution splits over tasks.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripledger.llm.common import stored


def forest(near: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect just what the links (left by right) connect."""
    out = []
    todo = near.any(axis=1)
    open_right = np.ones(len(right), bool)
    while todo.any():
        root = int(np.argmax(todo))
        front = np.zeros(len(left), bool)
        front[root] = True
        while front.any():
            todo &= ~front
            reached = near[front].any(axis=0) & open_right
            open_right &= ~reached
            out += [(int(left[root]), int(x)) for x in right[reached]]
            front = near[:, reached].any(axis=1) & todo
            out += [(int(left[root]), int(x)) for x in left[front]]
    return [(a, b) for a, b in out if a != b]


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node either hangs below one other node, or has nodes hanging below it."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.where("up > 1 OR up = 1 AND down = 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(``node``, ``label``) for every node of the undirected edges (``u``, ``v``) that is not itself
    the least of its component; ``label`` is that least node. Loops and repeated edges do no harm;
    edges with a null end are ignored. No edges give no rows."""
    now = stored(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
        "edges",
    )
    while not _are_stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.distinct(), "large-star")
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")
    return now.select(F.col("u").alias("node"), F.col("v").alias("label"))
