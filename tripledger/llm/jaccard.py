"""Exact n-gram Jaccard join by vertical partitioning.

A document's set holds the hashes of its distinct word n-grams. All n-grams have one global order (by
hash); cutting that order into fragments cuts every set into segments. Two uses are made of it:

* Candidates. Sets that link differ in few n-grams, so of enough fragments most hold equal segments.
  A set with ``n`` n-grams may differ from a partner in at most ``d = n * (1 - t) / t``; it gives the
  hashes of its ``d + 1`` first non-empty segments, long ones first, and two linked sets give one in
  common (prefix filter on segments). The number of fragments depends on the size alone, and a set whose partners
  may use the next finer cut gives that one's segments too. Sets so small that ``d`` reaches the
  number of their segments also give the first n-grams of the classical prefix filter.
* Overlaps. Sets that may link are compared fragment by fragment: each fragment's partial overlaps
  are counted for all pairs of a bounded block at once, and the counts are summed per pair.

Equal sets are one node from the start. Large families of near copies are contracted before anything
is compared in pairs: every set is compared with one centre of its family, goes under the centre's
name if they link, and only what may still link across names goes on. A set drops out for good when too
few of its n-grams occur under any other name for a link with even the smallest partner it can have.
What is left is compared in blocks of bounded size, each block pair in its own task, and gives
no pairs but a spanning forest of the links. No link between different texts is lost.

A set is told apart by a 128-bit hash. A 64-bit half of it is its short name in the joins; should two sets have one half, they
get other names. N-grams are identified by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripledger.llm.bitmap import may_be_wanted, those_maybe_wanted
from tripledger.llm.common import as_text, at_rest, fresh_name, mix64, numbers_of, sole_memory, stored, texts_of, utf8
from tripledger.llm.components import components, forest
from tripledger.llm.tokens import in_steps

#: Sets and n-grams that one block may hold; a block pair is compared in one task.
BLOCK_SETS = 256
BLOCK_GRAMS = 1 << 17
#: Fragments of the global order in which overlaps are counted.
FRAGMENTS = 8
#: Word hashes a worker remembers.
REMEMBERED = 100_000

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_words: dict[bytes, int] = {}


@dataclass(frozen=True)
class Likeness:
    """Sets link when ``den * |A and B| >= num * |A or B|``."""

    width: int = 5
    num: int = 8
    den: int = 10

    def differing(self, n: int) -> int:
        """How many n-grams may be in one of two linked sets only, if one has ``n``."""
        return n * (self.den - self.num) // self.num

    def level(self, n: int) -> int:
        """The cut for sets up to ``n``: 2 ** level fragments, somewhat more than may differ."""
        return (11 * (self.differing(n) + 1) // 10).bit_length()

    def levels(self, n: int) -> range:
        return range(self.level(n), self.level(n * self.den // self.num) + 1)


def _word_hash(word: bytes) -> int:
    found = _words.get(word)
    if found is None:
        if len(_words) >= REMEMBERED:
            _words.clear()
        found = _words[word] = xxhash.xxh3_64_intdigest(word)
    return found


def _forget() -> None:
    """A task's function holds a copy of ``_words`` itself; this one finds the worker's."""
    _words.clear()


def grams(text: str, width: int) -> np.ndarray:
    """Sorted distinct hashes of the text's word n-grams; the whole text if it has fewer words."""
    words = utf8(text).lower().split()  # bytes: only A-Z change, only ASCII blanks separate
    if not words:
        return np.empty(0, np.uint64)
    hashed = np.fromiter(map(_word_hash, words), np.uint64, len(words))
    span = min(width, len(words))
    total = np.zeros(len(words) - span + 1, np.uint64)
    for k in range(span):
        total = mix64(total * _ODD[0] + hashed[k : k + len(total)] + _ODD[1])
    return np.unique(total)


def signature(found: np.ndarray, like: Likeness) -> np.ndarray:
    """Hashes of which two linked sets have at least one in common."""
    n = len(found)
    most = like.differing(n)
    out, weak = [], False
    scrambled = mix64(found ^ _ODD[2])
    for level in like.levels(n):
        fragment = found >> np.uint64(64 - level) if level else np.zeros(n, np.uint64)
        begins = np.flatnonzero(np.concatenate(([True], fragment[1:] != fragment[:-1])))
        where = fragment[begins] * _ODD[0] + _ODD[1:2] * np.uint64(level + 1)
        segments = mix64(np.add.reduceat(scrambled, begins) + where)
        weak = weak or len(segments) <= most
        # Long segments first: they are seldom equal by chance. The order is the same for every set.
        sizes = np.diff(np.append(begins, n))
        out.append(segments[np.lexsort((segments, -sizes))[: most + 1]])
    if weak:
        least = -(-n * like.num // like.den)  # shared at least, of the larger set
        out.append(mix64(found[: n - least + 1] + _ODD[2]))
    return np.unique(np.concatenate(out))


def _identity(raw: bytes) -> tuple[int, int]:
    whole = xxhash.xxh3_128_intdigest(raw)
    return (whole >> 64) - (1 << 63), (whole & ((1 << 64) - 1)) - (1 << 63)


def _signed(docs: DataFrame, like: Likeness, text: str, identify=_identity) -> DataFrame:
    """Per row: the set's identity (``a``, ``b``), its short name ``set_id``, size and signature; stored."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sole_memory("words", _forget)
        for batch in batches:
            keys, texts = numbers_of(batch["doc_id"]), texts_of(batch["text"])
            for begin, end in in_steps(texts):
                out = []
                for key, t in zip(keys[begin:end], texts[begin:end], strict=True):
                    found = grams(t, like.width)
                    if not len(found):
                        out.append((key, None, None, 0, []))
                        continue
                    out.append((key, *identify(found.tobytes()), len(found), signature(found, like).view(np.int64)))
                yield pd.DataFrame(out, columns=["doc_id", "a", "b", "n", "tokens"], dtype=object)
        _forget()
        at_rest()

    rows = docs.select(as_text("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return _named(stored(rows.mapInPandas(sign, "doc_id long, a long, b long, n long, tokens array<long>"), "signatures"))


def _named(signed: DataFrame) -> DataFrame:
    """With ``set_id``: ``a``, or another hash of both halves for sets that share their first half with other ones."""
    halves = signed.where("a is not null").groupBy("a").agg(F.min("b").alias("low"), F.max("b").alias("high"))
    clashes = stored(halves.where("low <> high").select("a", F.lit(True).alias("clashes")), "clashes")
    if clashes.isEmpty():  # as a rule: some few are to be expected among 10 ** 10 sets
        return signed.withColumn("set_id", F.col("a"))
    marked = stored(signed.join(clashes, "a", "left"), "marked")
    for salt in range(1, 100):
        name = F.when(F.col("clashes"), F.xxhash64("a", "b", F.lit(salt))).otherwise(F.col("a"))
        named = marked.withColumn("set_id", F.when(F.col("a").isNotNull(), name)).drop("clashes")
        sets = named.where("set_id is not null").groupBy("set_id").agg(
            *[f(c).alias(f"{c}_{k}") for c in ("a", "b") for k, f in enumerate((F.min, F.max))]
        )
        if sets.where("a_0 <> a_1 or b_0 <> b_1").isEmpty():
            return named
    raise RuntimeError("no names found for sets")


def _grams_of(docs: DataFrame, wanted: DataFrame, like: Likeness, text: str, identify=_identity) -> DataFrame:
    """(``set_id``, ``n``, ``grams``) of the wanted (``doc_id``, ``set_id``, ``a``, ``b``), from the texts again."""

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sole_memory("words", _forget)
        for batch in batches:
            keys, texts = batch["set_id"].tolist(), texts_of(batch["text"])
            halves = list(zip(batch["a"].tolist(), batch["b"].tolist(), strict=True))
            for begin, end in in_steps(texts):
                out = []
                for key, both, t in zip(keys[begin:end], halves[begin:end], texts[begin:end], strict=True):
                    found = grams(t, like.width)
                    if len(found) and identify(found.tobytes()) == both:  # else another row of this doc_id
                        out.append((key, len(found), found.view(np.int64)))
                yield pd.DataFrame(out, columns=["set_id", "n", "grams"], dtype=object)
        _forget()
        at_rest()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    # The same join at every size, here and where the n-grams are joined: a broadcast on small tables
    # only would hide what texts and sets cost to move.
    rows = rows.where(F.col("doc_id").isNotNull()).where(may_be_wanted(wanted, "doc_id", F.col("doc_id")))
    return rows.join(wanted.hint("merge"), "doc_id").select("set_id", "a", "b", "text").mapInPandas(
        gather, "set_id long, n long, grams array<long>"
    )


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Common n-grams of every left with every right set: partial counts per fragment, summed."""
    both = left + right
    owner = np.repeat(np.arange(len(both)), [len(x) for x in both])
    every = np.concatenate(both).view(np.uint64) if both else np.empty(0, np.uint64)
    fragment = every >> np.uint64(64 - FRAGMENTS.bit_length() + 1)
    total = np.zeros((len(left), len(right)), np.float32)
    for f in range(FRAGMENTS):
        mine = fragment == f
        values, column, count = np.unique(every[mine], return_inverse=True, return_counts=True)
        shared = np.flatnonzero(count > 1)
        rank = np.full(len(values), -1)
        rank[shared] = np.arange(len(shared))
        column, rows = rank[column], owner[mine]
        rows, column = rows[column >= 0], column[column >= 0]
        for begin in range(0, len(shared), 4096):  # bounds the dense step
            some = (column >= begin) & (column < begin + 4096)
            dense = np.zeros((len(both), min(4096, len(shared) - begin)), np.float32)
            dense[rows[some], column[some] - begin] = 1
            total += dense[: len(left)] @ dense[len(left) :].T
    return total.astype(np.int64)


def _compared(rows: DataFrame, key: list[str], like: Likeness) -> DataFrame:
    """Links between side 0 and side 1 of each group, as edges (``u``, ``v``); a row may be on both sides
    (side 2), then it is compared with all."""

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates(["set_id", "side"])
        sets, ids, sizes = group["grams"].tolist(), group["set_id"].to_numpy(), group["n"].to_numpy()
        a, b = (np.flatnonzero(group["side"].isin(s)) for s in ((0, 2), (1, 2)))
        common = overlaps([sets[k] for k in a], [sets[k] for k in b])
        union = sizes[a][:, None] + sizes[b][None, :] - common
        near = (like.den * common >= like.num * union) & (ids[a][:, None] != ids[b][None, :])
        return pd.DataFrame(forest(near, ids[a], ids[b]), columns=["u", "v"], dtype="int64")

    return rows.groupBy(*key).applyInPandas(compare, "u long, v long")


def _shared(members: DataFrame, label: str) -> DataFrame:
    """Tokens that sets of different labels give: (``token``, ``centre``), the least label."""
    sides = members.groupBy("token").agg(F.min(label).alias("centre"), F.max(label).alias("other"))
    return sides.where("centre <> other").select("token", "centre")


def _slices(sets: str, grams_: str):
    """How many blocks hold that many sets and n-grams."""
    return F.greatest(F.ceil(F.expr(sets) / BLOCK_SETS), F.ceil(F.expr(grams_) / BLOCK_GRAMS), F.lit(1)).cast("int")


def _star_links(members: DataFrame, candidates: DataFrame, like: Likeness) -> DataFrame:
    """Links (``u``: centre, ``v``) of every set with one centre: the least set that shares a token with it."""
    centres = stored(_shared(members, "set_id"), "centres")
    star = members.join(centres, "token").groupBy("set_id").agg(F.min("centre").alias("centre"), F.first("n").alias("n"))
    star = stored(star.where("set_id <> centre"), "star")
    sizes = star.groupBy("centre").agg(F.count("*").alias("c"), F.sum("n").alias("g"))
    sizes = stored(sizes.select("centre", _slices("c", "g").alias("slices")), "star-sizes")
    outer = star.join(sizes, "centre").select(
        "centre", F.pmod(F.xxhash64("set_id"), F.col("slices")).cast("int").alias("slice"), "set_id", F.lit(1).alias("side")
    )
    inner = sizes.select(
        "centre", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"),
        F.col("centre").alias("set_id"), F.lit(0).alias("side"),
    )
    rows = outer.unionByName(inner).join(candidates.hint("merge"), "set_id")
    return stored(_compared(rows, ["centre", "slice"], like), "star-links")


def _block_links(members: DataFrame, candidates: DataFrame, like: Likeness) -> DataFrame:
    """All links among the members that share tokens, directly or over others, block by block."""
    centres = stored(_shared(members, "set_id"), "centres")
    edges = members.join(centres, "token").select(F.col("set_id").alias("u"), F.col("centre").alias("v"))
    family = components(edges)
    sets = members.select("set_id", "n").distinct()
    named = sets.join(family.withColumnRenamed("node", "set_id"), "set_id", "left").select(
        "set_id", "n", F.coalesce("label", "set_id").alias("family")
    )
    named = stored(named, "families")
    sizes = named.groupBy("family").agg(F.count("*").alias("c"), F.sum("n").alias("g")).where("c > 1")
    sizes = stored(sizes.select("family", _slices("c", "g").alias("slices")), "family-sizes")
    placed = named.join(sizes, "family").select(
        "family", "set_id", "slices", F.pmod(F.xxhash64("set_id"), F.col("slices")).cast("int").alias("block")
    )
    # Each block meets every other once, and itself.
    meets = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).select(
        "family", "set_id", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"),
        F.when(F.col("block") == F.col("other"), 2).when(F.col("block") < F.col("other"), 0).otherwise(1).alias("side"),
    )
    rows = meets.join(candidates.hint("merge"), "set_id")
    return stored(_compared(rows, ["family", "a", "b"], like), "block-links")


def _enough(available, n, least, like: Likeness):
    """Whether so many available n-grams can make a link with a partner of at least ``least``."""
    smallest = F.greatest(least, F.ceil(n * like.num / like.den))
    return available * (like.num + like.den) >= like.num * (n + smallest)


def _labelled(docs: DataFrame, like: Likeness, text: str, identify=_identity) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n``, the set's identity (``a``, ``b``) and ``label``: the least name of a set that links
    reach, null without words; stored."""
    signed = _signed(docs, like, text, identify)
    named = linked_sets(docs, signed, like, text, identify).withColumnRenamed("node", "set_id")
    rows = signed.select("doc_id", "n", "a", "b", "set_id").join(named, "set_id", "left")
    return stored(rows.select("doc_id", "n", "a", "b", F.coalesce("label", "set_id").alias("label")), "labelled")


def classes(docs: DataFrame, like: Likeness = Likeness(), text: str = "text", identify=_identity) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_shingles`` and ``component_id``, the least ``doc_id`` that links reach.

    A text without words has no set, links with nothing and is its own component; so is a row
    without ``doc_id``, whose component is null. Repeated rows are each returned. Other columns are
    not looked at; an empty table gives no rows.
    """
    rows = _labelled(docs, like, text, identify).withColumnRenamed("n", "n_shingles")
    least = stored(rows.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("least")), "least")
    return rows.join(least, "label", "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id")).alias("component_id")
    )


def linked_sets(docs: DataFrame, signed: DataFrame, like: Likeness, text: str, identify=_identity) -> DataFrame:
    """(``node``, ``label``) of the sets that links join, see ``components``."""
    given = signed.where("set_id is not null and doc_id is not null")
    tokens = given.select("set_id", "n", F.explode("tokens").alias("token"))
    sides = tokens.groupBy("token").agg(F.min("set_id").alias("a"), F.max("set_id").alias("b"), F.min("n").alias("least"))
    shared = stored(sides.where("a <> b").select("token", "least"), "shared-tokens")
    # Only tokens that others may give too are moved again, once for all copies of a set.
    kept = given.withColumn("kept", those_maybe_wanted(shared, "token", F.col("tokens"))).where(F.size("kept") > 0)
    sets = kept.groupBy("set_id").agg(
        F.min("doc_id").alias("doc_id"), *[F.min(c).alias(c) for c in ("n", "a", "b")], F.first("kept").alias("kept")
    )
    sets = stored(sets, "sets")
    members = sets.select("set_id", "n", F.explode("kept").alias("token")).join(shared, "token")
    members = stored(members, "members")
    bounds = stored(members.groupBy("set_id").agg(F.min("least").alias("least")), "bounds")
    wanted = sets.select("set_id", "doc_id", "a", "b").join(bounds.select("set_id"), "set_id")
    candidates = stored(_grams_of(docs, stored(wanted, "wanted"), like, text, identify), "candidate-grams")
    # N-grams that one candidate alone has cannot be common to it and a partner.
    sides = candidates.select("set_id", F.explode("grams").alias("gram")).groupBy("gram").agg(
        F.min("set_id").alias("a"), F.max("set_id").alias("b")
    )
    lonely = sides.where("a = b").groupBy(F.col("a").alias("set_id")).agg(F.count("*").alias("lonely"))
    alive = (
        candidates.select("set_id", "n").distinct()
        .join(bounds.select("set_id", "least"), "set_id")
        .join(lonely, "set_id", "left")
        .where(_enough(F.col("n") - F.coalesce("lonely", F.lit(0)), F.col("n"), F.col("least"), like))
        .select("set_id")
    )
    members = stored(members.join(stored(alive, "alive"), "set_id", "left_semi"), "alive-members")

    # A set that links with its centre goes under the centre's name from here on.
    star = _star_links(members, candidates, like)
    named = star.groupBy(F.col("v").alias("set_id")).agg(F.min("u").alias("label"))
    labelled = members.join(named, "set_id", "left").withColumn("label", F.coalesce("label", "set_id"))
    labelled = stored(labelled, "labelled-members")
    mixed = stored(_shared(labelled, "label").select("token"), "mixed")
    rest = stored(labelled.join(mixed, "token"), "rest")

    # Once more, now against sets under other names only.
    spread = candidates.join(rest.select("set_id", "label").distinct().hint("merge"), "set_id").select(
        "set_id", "label", F.explode("grams").alias("gram")
    )
    elsewhere = stored(_shared(spread.withColumnRenamed("gram", "token"), "label").select(F.col("token").alias("gram")), "elsewhere")
    available = spread.join(elsewhere, "gram").groupBy("set_id").agg(F.count("*").alias("available"))
    sizes = rest.groupBy("set_id").agg(F.first("n").alias("n"), F.min("least").alias("least"))
    able = sizes.join(available, "set_id").where(_enough(F.col("available"), F.col("n"), F.col("least"), like))
    rest = stored(rest.join(able.select("set_id"), "set_id", "left_semi"), "rest")

    return components(star.unionByName(_block_links(rest, candidates, like)))


def first_of_each(docs: DataFrame, like: Likeness = Likeness(), text: str = "text", identify=_identity) -> DataFrame:
    """``docs`` without the rows whose text links, directly or over others, with that of a row that stays: of each component
    the text with the least ``doc_id`` stays, in its own columns.

    Rows that repeat a ``doc_id`` are judged by their texts: an unlinked one stays, of rows with one id and equal sets one stays. Rows
    without ``doc_id`` or without words all stay. Only rows that may have to go are moved.
    """
    rows = _labelled(docs, like, text, identify).where("doc_id is not null")
    heads = rows.where("label is not null").groupBy("label").agg(F.min(F.struct("doc_id", "a", "b")).alias("head"))
    marked = rows.join(stored(heads, "heads"), "label", "left")
    stays = F.col("label").isNull() | (F.struct("doc_id", "a", "b") == F.col("head"))
    marked = stored(marked.select("doc_id", "a", "b", F.coalesce(stays, F.lit(False)).alias("stays")), "marked")
    by_id = marked.groupBy("doc_id").agg(F.count("*").alias("c"), F.count_if("stays").alias("s"))
    # The ids of which something goes, or which repeat; of the latter some rows may stay.
    touched = by_id.where("s = 0 or c > 1").select(F.col("doc_id").alias("id"), (F.col("s") > 0).alias("mixed"))
    touched = stored(touched, "touched")
    if touched.isEmpty():
        return docs
    maybe, key = fresh_name(docs.columns, "maybe"), fresh_name(docs.columns, "key")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    flagged = docs.withColumn(key, F.col("doc_id").cast("long"))
    seen = may_be_wanted(touched, "id", F.coalesce(F.col(key), F.lit(0)))
    flagged = flagged.withColumn(maybe, F.col(key).isNotNull() & seen)
    suspects = stored(flagged.where(F.col(maybe)), "suspects")
    renamed = touched.withColumnRenamed("id", key)
    out = flagged.where(~F.col(maybe)).select(columns)
    out = out.unionByName(suspects.join(renamed.select(key).hint("merge"), key, "left_anti").select(columns))
    if touched.where("mixed").isEmpty():
        return out
    part = fresh_name(docs.columns, "part")

    @F.pandas_udf("a long, b long")
    def identity(texts: pd.Series) -> pd.DataFrame:
        found = [grams(t, like.width) for t in texts_of(texts)]
        halves = [identify(x.tobytes()) if len(x) else (None, None) for x in found]
        return pd.DataFrame({name: pd.Series([h[k] for h in halves], dtype="Int64") for k, name in enumerate("ab")})

    repeated = suspects.join(renamed.where("mixed").select(key), key, "left_semi")
    repeated = stored(repeated.withColumn(part, identity(F.col(f"`{text}`").cast("string"))), "repeated")
    wordless = repeated.where(F.col(f"{part}.a").isNull())
    stay = marked.where("stays and a is not null").select(F.col("doc_id").alias(key), F.struct("a", "b").alias(part)).distinct()
    one = repeated.join(stay, [key, part], "left_semi").groupBy(key, part).agg(
        F.min_by(F.struct(*columns), F.to_json(F.struct(*columns))).alias(maybe)
    )
    return out.unionByName(wordless.select(columns)).unionByName(one.select(f"{maybe}.*"))
