"""Personal data and the terms that give it away: information-theoretic sanitisation in SQL functions.

Base spans. Four kinds are found by pattern and check, leftmost and without overlap within a kind:
e-mail and IP addresses, card and telephone numbers. Every distinct value is a protected entity.

Disclosing terms. A word in an entity's documents reveals it to the degree that their co-occurrence
in the corpus is more than chance. With document counts ``n``, the pointwise mutual information
``log(n(e, t) * N / (n(e) * n(t)))`` is compared with the entity's information content ``log(N / n(e))``:
a share of 1 means that the term occurs only with the entity. Terms that exceed ``generalise`` are
replaced by a placeholder, those that exceed ``remove`` are taken out, wherever they stand in a document that
holds the entity. No count is too small to be judged, but a pair must meet more often than chance explains: were the
term's documents drawn at random, the probability (Chernoff's bound) of as many with the entity is at most ``chance``.

Most words of a corpus are rare, and some rare ones stand beside any entity. So the terms of an entity that are alike
(equally frequent, equally often with it) are judged together: the corpus has so many terms of this frequency, and each would
meet the entity's documents as often in proportion to their share of all words; if this expects more than
``ordinary`` of the number found, they are ordinary words and stay.

Everything is a DataFrame expression: no Python runs on the executors. Counts over the corpus are
combined before they are shuffled; pairs exist for documents with entities only, and entities that share
all their documents are counted as one.

Defined results: a null text is empty and has no spans; repeated rows are each judged (and each count);
other columns are passed on untouched; an empty table gives no rows.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripledger.llm.common import discard, fresh_name, stored

# Java patterns that find what the plain ones find, leftmost and greedy, but look at no character
# twice: a run of fitting characters is only tried at its begin or where the last match ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
#: What a match ``h`` must fulfil; a failing match is dropped.
CHECKS = {
    "email": "true",
    "ip": rf"h RLIKE '^{_BYTE}(?:[.]{_BYTE}){{3}}$'",
    "card": """length(regexp_replace(h, '[ -]', '')) BETWEEN 16 AND 19 AND aggregate(
        sequence(1, length(regexp_replace(h, '[ -]', ''))), 0, (a, k) -> a +
        CASE WHEN k % 2 = 1 THEN int(substr(reverse(regexp_replace(h, '[ -]', '')), k, 1))
        ELSE int(substr('0246813579', int(substr(reverse(regexp_replace(h, '[ -]', '')), k, 1)) + 1, 1)) END) % 10 = 0""",
    "phone": "length(regexp_replace(h, '[^0-9]', '')) BETWEEN 8 AND 15",
}
#: The same entity however it is written.
SAME = {"email": "lower(h)", "ip": "h", "card": "regexp_replace(h, '[ -]', '')", "phone": "regexp_replace(h, '[^0-9]', '')"}
WORD = r"[\p{L}\p{M}]{3,}"
#: Lengths are summed over stretches of so many matches, so that positions cost no quadratic time.
STRETCH = 256
#: Terms to look up are dealt into so many lists.
LISTS = 64


@dataclass(frozen=True)
class Disclosure:
    chance: float = 0.002
    generalise: float = 0.85
    remove: float = 0.97
    ordinary: float = 0.2


def matches(text: Column, pattern: str) -> Column:
    """Struct of the matches and of how far each goes, from the end of the one before (with the rest last).

    Positions follow by ``placed`` once this is stored: in one projection Spark would search again
    for every match.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    return F.struct(hits.alias("hits"), F.when(F.size(hits) > 0, gaps).alias("gaps"))


def placed(found: str) -> str:
    """SQL: the matches as an array of (s, e, h): start, end (exclusive) and text, in code points."""
    lens = f"zip_with({found}.gaps, {found}.hits, (g, h) -> g + coalesce(length(h), 0))"
    return f"""transform(array(named_struct('l', {lens}, 'g', {found}.gaps, 'h', {found}.hits)), w ->
        transform(array(transform(sequence(0, size(w.l) div {STRETCH}), b ->
            aggregate(slice(w.l, 1, b * {STRETCH}), 0, (a, x) -> a + x))), base ->
        transform(w.h, (h, i) -> transform(array(base[i div {STRETCH}] + w.g[i] +
            aggregate(slice(w.l, (i div {STRETCH}) * {STRETCH} + 1, i % {STRETCH}), 0, (a, x) -> a + x)),
            s -> named_struct('s', s, 'e', s + length(h), 'h', h))[0]))[0])[0]"""


def base_spans(docs: DataFrame, into: str, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """``docs`` with ``into``: the valid base spans (kind, s, e, entity), and a row number ``into``_row; and the stored
    table that they are read from.

    Kinds come in the listed order, then starts.
    """
    found, row = f"{into}_found", f"{into}_row"
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    searched = F.struct(*[matches(body, p).alias(k) for k, p in PATTERNS.items()])
    rows = stored(docs.withColumns({found: searched, row: F.monotonically_increasing_id()}), "searched")
    spans = [
        f"""CASE WHEN size({found}.{k}.hits) = 0 THEN array() ELSE transform(filter({placed(f'{found}.{k}')}, x ->
            exists(array(x.h), h -> {CHECKS[k]})), x -> named_struct('kind', '{k}', 's', x.s, 'e', x.e,
            'entity', transform(array(x.h), h -> '{k}:' || {SAME[k]})[0])) END"""
        for k in PATTERNS
    ]
    return rows.withColumn(into, F.expr(f"concat({', '.join(spans)})")).drop(found), rows


def _vocabulary(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lower))


def disclosing_terms(docs: DataFrame, rows: DataFrame, into: str, how: Disclosure, text: str = "text") -> DataFrame:
    """(``row``, ``gone``, ``marked``), stored: for each row with entities that some terms of it give away, those to
    remove and all of them."""
    row = f"{into}_row"
    # Words inside an address belong to the entity, not to its surroundings.
    beside = F.regexp_replace(F.col(f"`{text}`").cast("string"), F.lit(PATTERNS["email"]), F.lit(" "))
    private = stored(
        rows.where(F.size(into) > 0).select(
            F.col(row).alias("row"), F.array_distinct(F.transform(into, lambda x: x["entity"])).alias("entities"),
            _vocabulary(beside).alias("terms"),
        ),
        "private-terms",
    )
    # Entities with the same documents have the same counts: one group, known by its documents.
    held = private.select("row", F.explode("entities").alias("entity"))
    groups = held.groupBy("entity").agg(
        F.count("*").alias("n_entity"), F.bit_xor(F.xxhash64("row")).alias("a"), F.bit_xor(F.xxhash64("row", F.lit(1))).alias("b")
    )
    members = held.join(groups, "entity").select("row", F.struct("n_entity", "a", "b").alias("group")).distinct()
    members = stored(members, "groups")
    extents = members.join(private.select("row", F.size("terms").cast("long").alias("words")), "row")
    extents = extents.groupBy("group").agg(F.sum("words").alias("words"))
    met = members.join(private.select("row", "terms"), "row").select("group", F.explode("terms").alias("term"))
    pairs = stored(met.groupBy("group", "term").agg(F.count("*").alias("both")), "pairs")

    words = _vocabulary(F.col(f"`{text}`").cast("string"))
    counts = docs.select(F.explode(words).alias("term")).groupBy("term").agg(F.count("*").alias("n_term"))
    counts = stored(counts, "term-counts")
    # How many terms there are of each frequency, and how many words: one row per frequency.
    spectrum = stored(counts.groupBy("n_term").agg(F.count("*").alias("alike")), "spectrum")
    total = spectrum.agg(F.sum(F.col("n_term") * F.col("alike"))).first()[0] or 1
    pairs = pairs.join(counts, "term").withColumn("n_entity", F.col("group.n_entity"))
    terms = stored(scored(pairs, docs.count(), how), "unusual")
    terms = beyond_ordinary(terms.join(spectrum, "n_term").join(extents, "group"), total, how)
    terms = stored(terms.select("group", "term", (F.col("share") >= how.remove).alias("gone")), "disclosing")

    here = members.join(terms, "group").groupBy("row", "term").agg(F.max("gone").alias("gone"))  # removed, if any asks
    return stored(
        here.groupBy("row").agg(
            F.collect_list(F.when(F.col("gone"), F.col("term"))).alias("gone"), F.collect_list("term").alias("marked")
        ),
        "row-terms",
    )


def _dealt(terms: str) -> Column:
    return F.expr(f"transform(sequence(0, {LISTS - 1}), b -> filter({terms}, t -> pmod(xxhash64(t), {LISTS}) = b))")


def _has(lists: str, word: str) -> str:
    return f"array_contains({lists}[int(pmod(xxhash64({word}), {LISTS}))], {word})"


def scored(pairs: DataFrame, total: int, how: Disclosure) -> DataFrame:
    """Rows with ``n_entity``, ``n_term`` and ``both`` (documents) that disclose, with their ``share``."""
    every = F.lit(float(max(total, 1)))
    pairs = pairs.withColumn("n_term", F.greatest("n_term", "both"))
    information = F.log2(every / F.col("n_entity"))
    mutual = F.log2(F.col("both") * every / (F.col("n_entity") * F.col("n_term")))
    # An entity in every document carries no information that a term could give away.
    share = F.when(information > 0, mutual / information).otherwise(0.0)
    likely = F.col("n_entity") / every
    apart = F.col("n_term") - F.col("both")
    evidence = F.col("both") * F.log(F.col("both") / F.col("n_term") / likely) + F.when(
        apart > 0, apart * F.log(apart / F.col("n_term") / (1 - likely))
    ).otherwise(0.0)
    found = pairs.withColumn("share", share).where(F.col("share") >= how.generalise)
    return found.where(evidence >= -math.log(how.chance))


def beyond_ordinary(terms: DataFrame, total: int, how: Disclosure) -> DataFrame:
    """The rows of (``group``, ``term``, ``n_term``, ``both``; ``alike`` terms of this frequency; ``words`` in the group's documents, of
    ``total``) that are too many to be ordinary words."""
    found = terms.groupBy("group", "n_term", "both").agg(F.count("*").alias("found"))
    terms = terms.join(found, ["group", "n_term", "both"])
    part = F.least(F.col("words") / F.lit(float(total)), F.lit(1.0))
    with_it, without = F.col("both") / F.col("n_term"), 1 - F.col("both") / F.col("n_term")
    bound = F.col("both") * F.log(with_it / part) + F.when(
        (without > 0) & (part < 1), (F.col("n_term") - F.col("both")) * F.log(without / (1 - part))
    ).otherwise(0.0)
    expected = F.col("alike") * F.when(with_it > part, F.exp(-bound)).otherwise(1.0)
    return terms.where(expected <= how.ordinary * F.col("found"))


def all_spans(docs: DataFrame, into: str, how: Disclosure = Disclosure(), text: str = "text", whole: bool = True) -> DataFrame:
    """``docs`` with ``into``: base and term spans (kind, s, e, label), in order of kind and start.

    ``whole=False`` keeps texts of documents with base spans only, for callers that need no others.
    """
    row = f"{into}_row"
    rows, searched = base_spans(docs, into, text)
    if not whole:
        rows = rows.withColumn(text, F.when(F.size(into) > 0, F.col(f"`{text}`")))
    rows = stored(rows, "base-spans")
    discard(searched)
    terms = disclosing_terms(docs, rows, into, how, text)
    found, gone, marked, row_of = (fresh_name([*rows.columns, "row"], f"{into}_{n}") for n in ("words", "gone", "marked", "of"))
    terms = terms.select(F.col("row").alias(row_of), _dealt("gone").alias(gone), _dealt("marked").alias(marked))
    private = rows.where(F.size(into) > 0).join(terms, F.col(row) == F.col(row_of), "left").drop(row_of)
    words = matches(F.col(f"`{text}`").cast("string"), WORD)
    private = stored(private.withColumn(found, F.when(F.col(marked).isNotNull(), words)), "private-words")
    base = f"transform({into}, x -> named_struct('kind', x.kind, 's', x.s, 'e', x.e, 'label', '[' || upper(x.kind) || ']'))"
    # Words within an address go with it.
    extra = f"""CASE WHEN size({found}.hits) > 0 THEN transform(filter(filter({placed(found)},
        y -> {_has(marked, 'lower(y.h)')}), y -> NOT exists({into}, x -> x.s < y.e AND y.s < x.e)),
        y -> named_struct('kind', 'term', 's', y.s, 'e', y.e,
            'label', CASE WHEN {_has(gone, 'lower(y.h)')} THEN '' ELSE '[WORD]' END)) ELSE array() END"""
    private = private.withColumn(into, F.expr(f"concat({base}, {extra})")).drop(found, gone, marked, row)
    rest = rows.where(F.size(into) == 0).withColumn(into, F.expr(base)).drop(row)
    return rest.unionByName(private)


def sanitised(docs: DataFrame, how: Disclosure = Disclosure(), text: str = "text", length: str | None = None) -> DataFrame:
    """``docs`` in their own columns with every span's text replaced by its label; overlaps go as one.

    ``length`` names a column, if the table has it, that is to hold the new text's length where the text changed.
    """
    columns = [f"`{c}`" for c in docs.columns]
    into = f"spans_{uuid.uuid4().hex}"  # names are built from it, none may clash
    rows = all_spans(docs, into, how, text)
    ordered = fresh_name(rows.columns, "ordered")
    by_start = "(x, y) -> CASE WHEN x.s < y.s THEN -1 WHEN x.s > y.s THEN 1 WHEN x.e > y.e THEN -1 WHEN x.e < y.e THEN 1 ELSE 0 END"
    rows = rows.withColumn(ordered, F.expr(f"array_sort({into}, {by_start})"))
    # How far the spans before each one reach: maxima of whole stretches, then within the stretch.
    reach = fresh_name(rows.columns, "reach")
    ends = f"transform({ordered}, x -> x.e)"
    rows = rows.withColumn(reach, F.expr(f"""transform(array({ends}), v -> transform(array(
        transform(sequence(0, size(v) div {STRETCH}), b -> coalesce(array_max(slice(v, 1, b * {STRETCH})), 0))), base ->
        transform(v, (z, i) -> greatest(base[i div {STRETCH}],
            coalesce(array_max(slice(v, (i div {STRETCH}) * {STRETCH} + 1, i % {STRETCH})), 0))))[0])[0]"""))  # fmt: skip
    pieces = f"""transform({ordered}, (x, i) -> CASE WHEN x.s >= {reach}[i]
        THEN substr(`{text}`, {reach}[i] + 1, x.s - {reach}[i]) || x.label ELSE '' END)"""
    rest = f"substr(`{text}`, array_max({ends}) + 1)"
    clean = f"CASE WHEN size({ordered}) = 0 THEN `{text}` ELSE array_join({pieces}, '') || {rest} END"
    rows = rows.withColumn(text, F.expr(clean))
    if length in docs.columns:
        kind = docs.schema[length].dataType
        changed = F.when(F.size(ordered) > 0, F.length(text).cast(kind)).otherwise(F.col(length))
        rows = rows.withColumn(length, changed)
    return rows.select(*columns)


def report(docs: DataFrame, how: Disclosure = Disclosure()) -> DataFrame:
    """Per document the number of base spans of each kind, their digest, and all spans."""
    rows = all_spans(docs.select("doc_id", "text"), "found", how, whole=False)
    told = "transform({}, x -> concat_ws(':', x.kind, x.s, x.e))"
    base = "filter(found, x -> x.kind <> 'term')"
    counts = [F.expr(f"size(filter(found, x -> x.kind = '{k}'))").cast("long").alias(f"n_{k}") for k in PATTERNS]
    return rows.select(
        "doc_id", *counts,
        F.sha2(F.array_join(F.expr(told.format(base)), ","), 256).alias("base_sha256"),
        F.array_join(F.expr(told.format("found")), ",").alias("spans"),
    )
