"""The trie of conversation prefixes: which turns conversations share, and what sharing them saves.

A node is a sequence of turns that some conversation begins with. Sequences are told apart by 128 bits, the
exclusive or of one hash per (place, turn); as this needs no order of work, a conversation of any length is
hashed in parts by many tasks, and a node's parent is known without a look at other rows. Places come from
``common.ranked``, so no conversation is brought together in one task either.

Totals over subtrees (childless nodes, tokens saved) come from parallel tree contraction, see ``contraction``.
A node's ends are listed in stretches of ids and hashed stretch by stretch; a hash reads its input in order,
so one task reads the stretches of one node, as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripledger.llm.common import ranked, stored
from tripledger.llm.contraction import subtree_totals

#: Ids of one stretch are equal but for this many low bits.
STRETCH_BITS = 10
WORD = r"[^\x20\x09-\x0D]+"


def numbered(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(``conv_id``, ``part``, ``rank`` from 0, ``a`` and ``b``: hashes of the turn, ``words``) of all turns.

    Turns go by ``turn``, null first, then by role and text. Null role or text is empty. Rows without ``conv_id`` belong to
    no conversation and are left out; repeated rows are turns of their own.
    """
    rows = turns.select(
        F.col(f"`{conv}`").cast("long").alias("conv_id"), F.col(f"`{turn}`").cast("long").alias("turn"),
        *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(name) for c, name in ((role, "role"), (text, "text"))],
    ).where("conv_id is not null")
    slim = [
        "conv_id", F.xxhash64("role", "text").alias("a"), F.xxhash64("text", F.lit(1), "role").alias("b"),
        F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"),
    ]
    return ranked(rows, ["conv_id"], ["turn", "role", "text"], slim)


def sequences(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Numbered turns as they are: (turns: ``conv_id``, ``part``, ``depth`` from 1, ``a``, ``b``, ``words``; conversations:
    ``conv_id``, ``length``)."""
    turns = stored(turns, "turns")
    lengths = turns.groupBy("conv_id").agg(F.count("*").alias("length"))
    return turns.withColumn("depth", F.col("rank") + 1).drop("rank"), stored(lengths, "lengths")


def rebuilt(turns: DataFrame, every: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """Numbered turns with new beginnings: conversation c gets the first h turns of conversation c - c % ``every`` in the
    place of its own first h, with h = crc32(c in decimal) % ``heads``. Fewer turns there give a shorter beginning, none
    none; a conversation may end up without turns. ``%`` has the sign of c. Result as of ``sequences``.
    """
    turns = stored(turns, "turns")
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    convs = stored(
        convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % every).withColumn(
            "h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
        ),
        "conversations",
    )
    bases = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("there"))
    convs = convs.join(bases, "base", "left").withColumn("lead", F.least("h", F.coalesce("there", F.lit(0))))
    convs = stored(
        convs.select("conv_id", "base", "h", "lead", (F.col("lead") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")),
        "rebuilt",
    )
    own = turns.join(convs.select("conv_id", "h", "lead"), "conv_id").where("rank >= h")
    own = own.withColumn("depth", F.col("rank") - F.col("h") + F.col("lead") + 1)
    # A beginning is at most heads - 1 turns and goes to at most ``every`` conversations.
    first = turns.where(F.col("rank") < heads - 1).withColumnRenamed("conv_id", "base")
    first = first.join(convs.where("h > 0").select("conv_id", "base", "h"), "base").where("rank < h")
    first = first.withColumn("depth", F.col("rank") + 1).withColumn("part", F.lit(-1).cast("long"))
    columns = ["conv_id", "part", "depth", "a", "b", "words"]
    return own.select(columns).unionByName(first.select(columns)), convs.select("conv_id", "length")


def prefixes(turns: DataFrame) -> DataFrame:
    """Per turn the identity (``x``, ``y``) of the sequence up to it, (``up_x``, ``up_y``) of the one before."""
    rows = turns.select(
        "conv_id", "part", "depth", "words", F.xxhash64("a", "b", "depth").alias("s"), F.xxhash64("b", "depth", "a").alias("t")
    )
    inside = Window.partitionBy("conv_id", "part").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    rows = stored(rows.withColumns({"x": F.bit_xor("s").over(inside), "y": F.bit_xor("t").over(inside)}), "running")
    parts = rows.groupBy("conv_id", "part").agg(F.bit_xor("s").alias("p"), F.bit_xor("t").alias("q"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("conv_id", "part", *[F.coalesce(F.bit_xor(c).over(before), F.lit(0)).alias(c) for c in ("p", "q")])
    rows = rows.join(parts, ["conv_id", "part"])
    whole = {"x": F.col("x").bitwiseXOR(F.col("p")), "y": F.col("y").bitwiseXOR(F.col("q"))}
    rows = rows.select("conv_id", "depth", "words", "s", "t", *[c.alias(name) for name, c in whole.items()])
    return stored(
        rows.withColumns({"up_x": F.col("x").bitwiseXOR(F.col("s")), "up_y": F.col("y").bitwiseXOR(F.col("t"))}).drop("s", "t"),
        "prefixes",
    )


def trie(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes, and the prefixes they were made of (``conv_id``, ``depth``, ``x``, ``y``).

    Per node: ``x``, ``y`` (its identity, 0 at the root), ``node``, ``parent`` (numbers of this run), ``conv_id`` (smallest
    member), ``depth``, ``parent_conv_id``, ``n_convs``, ``words`` (of its last turn), ``n_children``, ``n_leaves`` and ``saved_tokens``.
    Without conversations there is no node.
    """
    rows = prefixes(turns)
    nodes = rows.groupBy("x", "y").agg(
        F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.count("*").alias("n_convs"),
        F.min("words").alias("words"), F.min("up_x").alias("up_x"), F.min("up_y").alias("up_y"),
    )
    zero = F.lit(0).cast("long")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(
        zero.alias("x"), zero.alias("y"), "conv_id", zero.alias("depth"), "n_convs", zero.alias("words"),
        F.lit(None).cast("long").alias("up_x"), F.lit(None).cast("long").alias("up_y"),
    )
    nodes = stored(nodes.unionByName(root).withColumn("node", F.monotonically_increasing_id()), "nodes")
    above = nodes.select(
        F.col("x").alias("up_x"), F.col("y").alias("up_y"), F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id")
    )
    nodes = stored(nodes.join(above, ["up_x", "up_y"], "left").drop("up_x", "up_y"), "tree")
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = stored(nodes.join(children, "node", "left").fillna(0, ["n_children"]), "tree")
    own = nodes.select(
        "node", "parent", F.when(F.col("n_children") == 0, 1).otherwise(0).alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"),
    )
    return nodes.join(subtree_totals(own, ["n_leaves", "saved_tokens"]), "node"), rows


def end_digests(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """(``x``, ``y``, ``ends_sha256``) of the nodes at which conversations end: SHA-256 of their ids, ascending, comma-joined."""
    zero = F.lit(0).cast("long")
    ends = rows.join(convs, "conv_id").where("depth = length").select("x", "y", "conv_id")
    ends = ends.unionByName(convs.where("length = 0").select(zero.alias("x"), zero.alias("y"), "conv_id"))
    stretches = ends.groupBy("x", "y", F.shiftright("conv_id", STRETCH_BITS).alias("stretch")).agg(
        F.array_join(F.array_sort(F.collect_list("conv_id")), ",").alias("ids")  # distinct: 2 ** STRETCH_BITS at most
    )

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, running = None, None
        for batch in batches:
            out = []
            for x, y, ids in zip(batch["x"].tolist(), batch["y"].tolist(), batch["ids"].tolist(), strict=True):
                if (x, y) == now:
                    running.update(b",")
                else:
                    if now is not None:
                        out.append((*now, running.hexdigest()))
                    now, running = (x, y), hashlib.sha256()
                running.update(ids.encode())
            yield pd.DataFrame(out, columns=["x", "y", "ends_sha256"])
        if now is not None:
            yield pd.DataFrame([(*now, running.hexdigest())], columns=["x", "y", "ends_sha256"])

    stretches = stretches.repartition("x", "y").sortWithinPartitions("x", "y", "stretch")
    return stretches.mapInPandas(hashed, "x long, y long, ends_sha256 string")


def report(conversations: DataFrame) -> DataFrame:
    """The nodes of the rebuilt conversations' trie. Further columns are not looked at; an empty table gives no rows."""
    turns, convs = rebuilt(numbered(conversations))
    nodes, rows = trie(turns, convs)
    found = nodes.join(stored(end_digests(rows, convs), "ends"), ["x", "y"], "left")
    return found.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )
