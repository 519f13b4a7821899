"""Subtree totals of a forest by parallel tree contraction, in rounds of joins.

Two moves alternate until no node is left:

* compress: every chain of nodes with one child each is spliced out. Pointers along the chain are doubled, so a
  chain of length n takes about log2(n) joins, whichever way the tree is shaped;
* rake: the leaves go, and what they hold is added to their parents. After a compress every inner node has two
  children or more, so at least half of the nodes go.

A raked leaf's total is final. A spliced node keeps the sum down to the end of its chain and the name of that
end; once the rounds are over they are re-expanded in reverse, each chain from the total of its end. There is
a logarithmic number of rounds, also in a tree that is one long chain or one wide star; sums for a node with
very many children are combined before the shuffle. Every round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripledger.llm.common import stored

#: Rounds halve the nodes at least: more of them mean that the parents form a ring.
MOST_ROUNDS = 64


def _edge(value: str) -> str:
    """What spliced nodes between a node and its present parent hold."""
    return f"over_{value}"


def subtree_totals(tree: DataFrame, values: list[str]) -> DataFrame:
    """(``node``, ``values``): per node the sums of its subtree, the node included.

    ``tree`` has ``node`` (distinct, not null), ``parent`` (null at a root) and whole-number ``values`` (null counts as
    0). Parents must be nodes and form no ring; a ring is an error. No nodes give no rows; further columns
    are not looked at.
    """
    held = [F.coalesce(F.col(v).cast("long"), F.lit(0)).alias(v) for v in values]
    live = stored(tree.select("node", "parent", *held, *[F.lit(0).cast("long").alias(_edge(v)) for v in values]), "tree")
    totals = live.select("node", *values).limit(0)
    chains = []
    rounds = 0
    while not live.isEmpty():
        rounds += 1
        if rounds > MOST_ROUNDS:
            raise ValueError("the parents form a ring")
        live, chain = _compressed(live, values)
        chains += [chain] if chain is not None else []
        live, leaves = _raked(live, values)
        totals = totals.unionByName(leaves)
    for chain in reversed(chains):
        ends = totals.select(F.col("node").alias("below"), *[F.col(v).alias(_edge(v)) for v in values])
        found = chain.join(ends, "below").select("node", *[(F.col(v) + F.col(_edge(v))).alias(v) for v in values])
        totals = totals.unionByName(stored(found, "expanded"))
    return totals


def _compressed(live: DataFrame, values: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """The nodes without the chains, with their number of children; and (``node``, ``below``: end of its chain, sums
    of the chain from the node on, without the end), None if there are no chains."""
    children = live.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(
        F.count("*").alias("kids"), F.min("node").alias("below"), *[F.sum(_edge(v)).alias(f"under_{v}") for v in values]
    )
    live = stored(live.join(children, "node", "left").fillna(0, ["kids"]), "children")
    links = live.where("kids = 1").select(
        "node", "parent", "below", *[(F.col(v) + F.col(f"under_{v}")).alias(v) for v in values], *[_edge(v) for v in values]
    )
    rest = live.where("kids <> 1").select("node", "parent", "kids", *values, *[_edge(v) for v in values])
    chain = stored(links.select("node", "below", *values, F.lit(False).alias("ended")), "chains")
    nodes = chain.count()
    if not nodes:
        return rest, None
    # After k doublings only nodes 2 ** k or more above their end still move: none, once that exceeds all nodes.
    for _ in range(nodes.bit_length() + 2):
        moving = chain.where(~F.col("ended"))
        if moving.isEmpty():
            break
        ahead = chain.select(
            F.col("node").alias("below"), F.col("below").alias("to"), F.col("ended").alias("there"),
            *[F.col(v).alias(f"more_{v}") for v in values],
        )
        moved = moving.join(ahead, "below", "left").select(
            "node", F.coalesce("to", "below").alias("below"),
            *[(F.col(v) + F.coalesce(f"more_{v}", F.lit(0))).alias(v) for v in values],
            F.coalesce("there", F.lit(True)).alias("ended"),
        )
        chain = stored(chain.where("ended").unionByName(moved), "chains")
    else:
        raise ValueError("the parents form a ring")
    # The end of a chain moves up to the parent of the chain's top.
    tops = links.join(links.select(F.col("below").alias("node")), "node", "left_anti")
    moved = tops.select("node", F.col("parent").alias("up"), *[F.col(_edge(v)) for v in values]).join(
        chain.drop("ended"), "node"
    ).select(
        F.col("below").alias("node"), "up", F.lit(True).alias("moved"),
        *[(F.col(v) + F.col(_edge(v))).alias(f"new_{v}") for v in values],
    )
    rest = rest.join(moved, "node", "left").select(
        "node", F.when(F.col("moved"), F.col("up")).otherwise(F.col("parent")).alias("parent"), "kids", *values,
        *[F.when(F.col("moved"), F.col(f"new_{v}")).otherwise(F.col(_edge(v))).alias(_edge(v)) for v in values],
    )
    return rest, chain.drop("ended")


def _raked(live: DataFrame, values: list[str]) -> tuple[DataFrame, DataFrame]:
    """The nodes without the leaves, which are added to their parents; and the leaves' totals."""
    live = stored(live, "spliced")
    leaves = live.where("kids = 0")
    given = leaves.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(
        *[F.sum(F.col(v) + F.col(_edge(v))).alias(f"more_{v}") for v in values]
    )
    rest = live.where("kids > 0").join(given, "node", "left").select(
        "node", "parent", *[(F.col(v) + F.coalesce(f"more_{v}", F.lit(0))).alias(v) for v in values],
        *[_edge(v) for v in values],
    )
    return stored(rest, "raked"), leaves.select("node", *values)
