"""Decontamination, disclosure and licence scan against plain Python."""

import hashlib
import re

import pytest
from corpus_helpers import extra
from pyspark.sql import functions as F

from tripledger.llm import decontaminate, disclosure, licences

DOCS = "doc_id long, text string"
ITEMS = "item_id long, text string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PASSAGE = "one two three four five six seven eight nine ten eleven twelve"


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute_report(docs, items, width=10):
    windows = {}
    for item, text in items:
        words = WORD.findall(fold(text)) if text is not None and item is not None else []
        for k in range(max(len(words) - width, 0) + 1 if words else 0):
            windows.setdefault(tuple(words[k : k + width]), set()).add(str(item))
    out = []
    for key, text in docs:
        words = WORD.findall(fold(text))
        hit, names = set(), set()
        for window, found in windows.items():
            for k in range(len(words) - len(window) + 1):
                if tuple(words[k : k + len(window)]) == window:
                    hit.update(range(k, k + len(window)))
                    names |= found
        told = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out.append((key, len(words), len(hit), len(names), told, bool(hit)))
    return sorted(out, key=str)


BENCH = [(1, PASSAGE), (2, "short item"), (2, "short item"), (10, "ÉTÉ à la mer"), (3, ""), (4, None), (None, "null id"),
         (5, PASSAGE.replace("twelve", "dozen")), (6, "Z9"), (7, "!!!")]
TEXTS = [PASSAGE, PASSAGE.upper().replace(" ", ", "), "x " + PASSAGE + " y " + PASSAGE, "a short, ITEM b short item", "short", "",
         None, "ÉTÉ à la mer", "été à la mer", "zz9 z9. z9", "null id", " ".join(PASSAGE.split()[:9]),
         PASSAGE.split(" ", 1)[1] + " dozen", "one " * 5000 + PASSAGE, "İstanbul short item", "short\x00item short\nitem"]


@pytest.mark.parametrize("bound", [1 << 20, 200])
def test_hits_equal_brute_force(spark, bound):
    docs = list(enumerate(TEXTS)) + [(3, TEXTS[3]), (None, "short item")]
    rows, items = spark.createDataFrame(docs, DOCS), spark.createDataFrame(BENCH, ITEMS)
    found = decontaminate.scanned(rows, items, broadcast_bytes=bound).select(
        "doc_id", "found.n_words", F.expr("aggregate(arrays_zip(found.starts, found.ends), 0, (a, s) -> a + s.ends - s.starts)"),
        F.size("found.items"), F.sha2(F.concat_ws(",", "found.items"), 256), F.size("found.items") > 0,
    )
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute_report(docs, BENCH)


def test_report_columns_and_empty_tables(spark):
    docs, items = spark.createDataFrame(list(enumerate(TEXTS)), DOCS), spark.createDataFrame(BENCH, ITEMS)
    assert sorted((tuple(r) for r in decontaminate.report(extra(docs), extra(items)).collect()), key=str) == brute_report(
        list(enumerate(TEXTS)), BENCH
    )
    assert decontaminate.report(docs.limit(0), items).count() == 0
    assert decontaminate.report(docs, items.limit(0)).where("contaminated").count() == 0


def test_documents_or_spans_go(spark):
    rows = [(1, f"Before, {PASSAGE.title()}. After!"), (2, "clean text\nstays as it is "), (3, None), (4, "short item")]
    docs, items = extra(spark.createDataFrame(rows, DOCS)), spark.createDataFrame(BENCH, ITEMS)
    kept = decontaminate.decontaminate(docs, items)
    assert kept.columns == docs.columns and {tuple(r)[:2] for r in kept.collect()} == set(rows[1:3])
    cut = decontaminate.decontaminate(docs, items, remove="spans")
    assert cut.columns == docs.columns
    assert dict(tuple(r)[:2] for r in cut.collect()) == {1: "Before, . After!", 2: rows[1][1], 3: None, 4: ""}
    with pytest.raises(ValueError, match="remove"):
        decontaminate.decontaminate(docs, items, remove="words")


# ---------------------------------------------------------------- disclosure

KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    twice = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
    return sum(x - 9 if x > 9 else x for x in twice) % 10 == 0


def valid(kind, hit):
    digits = re.sub("[^0-9]", "", hit)
    return {
        "email": lambda: True,
        "ip": lambda: all(int(p) <= 255 for p in hit.split(".")),
        "card": lambda: 16 <= len(digits) <= 19 and luhn(digits),
        "phone": lambda: 8 <= len(digits) <= 15,
    }[kind]()


def brute_spans(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in KINDS.items() for m in re.finditer(p, text or "") if valid(k, m.group())]


PRIVATE = ["a@b.c_d@e.f.g x@y a@b-.c-d..e a.b@c.d.", "1.2.3.4.5.6.7.8 300.1.1.1 0001.2.3.4 1.2.3 255.255.255.256",
           "4111 1111 1111 1111 and 4111-1111-1111-1111- 4111111111111112 41111111111111110000", "+1 (555) 123-4567. +49 30 12 ++1 2345678 9",
           "é@é.de ü a@b.de, ñ +12345678 ü 4111111111111111 \U0001f600 x@y.z", " ".join(f"u{k}@h{k}.com" for k in range(700)),
           "", None, "nothing at all", "+1 4111 1111 1111 1111", "@" * 5000 + "a" * 5000, "1." * 5000,
           "a@1.2.3.4 end"]


def test_base_spans_equal_python(spark):
    rows = list(enumerate(PRIVATE)) + [(0, PRIVATE[0]), (None, PRIVATE[0])]
    found = disclosure.report(extra(spark.createDataFrame(rows, DOCS)))
    want = []
    for key, text in rows:
        spans = brute_spans(text)
        counts = [sum(s.startswith(k + ":") for s in spans) for k in KINDS]
        want.append((key, *counts, hashlib.sha256(",".join(spans).encode()).hexdigest(), ",".join(spans)))
    assert sorted((tuple(r) for r in found.collect()), key=str) == sorted(want, key=str)
    assert disclosure.report(spark.createDataFrame([], DOCS)).count() == 0


def revealing():
    """Four documents in which a rare word stands by an address, and others without either."""
    rows = [(k, f"Note {k}: contact Zarathustra at z@old.example or the usual desk today") for k in range(4)]
    rows += [(10 + k, f"The usual desk is open today, number {k}, contact us") for k in range(40)]
    rows += [(60, "Zarathustra is a book"), (61, "far away " * 40 + "z@old.example")]
    return rows


def test_terms_that_reveal_an_entity_are_found_near_it(spark):
    rows = revealing()
    found = {r.doc_id: r.spans for r in disclosure.report(spark.createDataFrame(rows, DOCS)).collect()}
    for key, text in rows[:4]:
        at = text.index("Zarathustra")
        assert found[key].split(",")[0] == f"email:{text.index('z@')}:{text.index('z@') + 13}"
        assert f"term:{at}:{at + 11}" in found[key].split(",")
        assert f"term:{text.index('usual')}:{text.index('usual') + 5}" not in found[key]
    assert found[60] == "" and all(found[k] == "" for k, _ in rows[4:44])


def test_sanitised_texts_keep_everything_else(spark):
    docs = extra(spark.createDataFrame(revealing() + [(99, None)], DOCS)).withColumn("n_chars", F.length("text"))
    clean = disclosure.sanitised(docs, length="n_chars")
    assert clean.columns == docs.columns and clean.count() == docs.count()
    texts = {r.doc_id: r for r in clean.collect()}
    assert "z@old" not in texts[0].text and "Zarathustra" not in texts[0].text and "[EMAIL]" in texts[0].text
    assert texts[0].n_chars == len(texts[0].text) and texts[0].spans == "own spans"
    assert texts[60].text == "Zarathustra is a book" and texts[99].text is None
    hard = {r.doc_id: r.text for r in disclosure.sanitised(spark.createDataFrame(list(enumerate(PRIVATE)), DOCS)).collect()}
    assert all(not brute_spans(t) for t in hard.values())
    assert hard[8] == "nothing at all" and hard[12] == "[EMAIL] end"  # overlapping spans go as one


def test_no_python_runs_on_the_executors(spark):
    plan = disclosure.report(spark.createDataFrame(revealing(), DOCS))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# ---------------------------------------------------------------- licences


FILES = "path string, text string, is_licence_file boolean"


def test_own_licences_and_inheritance(spark):
    mit, apache = licences.TEMPLATES["MIT"], licences.TEMPLATES["Apache-2.0"]
    rows = [
        ("LICENSE", apache, True), ("a/LICENSE", f"{mit}\nmore words below", True), ("a/b/c/x.txt", "plain prose here", False),
        ("a/b/own.txt", f"text before\n{apache}\ntext after", False), ("d/y.txt", "plain", False), ("z.txt", "plain", None),
        ("a/b/c/x.txt", "plain prose here", False), ("e/LICENSE", "no licence in here", True), ("e/f.txt", None, False),
        (None, mit, True), (None, None, False), ("a/both/1", mit, True), ("a/both/2", apache, True), ("a/both/3", "", False),
    ]
    found = licences.scanned(extra(spark.createDataFrame(rows, FILES)))
    told = sorted(((r.path, r.own, r.licence, r.origin, r.directory) for r in found.collect()), key=str)
    assert told == sorted(
        [
            ("LICENSE", "Apache-2.0", "Apache-2.0", "own", None), ("a/LICENSE", "MIT", "MIT", "own", None),
            ("a/b/c/x.txt", None, "MIT", "directory", "a"), ("a/b/c/x.txt", None, "MIT", "directory", "a"),
            ("a/b/own.txt", "Apache-2.0", "Apache-2.0", "own", None), ("d/y.txt", None, "Apache-2.0", "directory", ""),
            ("z.txt", None, "Apache-2.0", "directory", ""), ("e/LICENSE", None, "Apache-2.0", "directory", ""),
            ("e/f.txt", None, "Apache-2.0", "directory", ""), (None, "MIT", "MIT", "own", None), (None, None, None, "none", None),
            ("a/both/1", "MIT", "MIT", "own", None), ("a/both/2", "Apache-2.0", "Apache-2.0", "own", None),
            ("a/both/3", None, "MIT", "directory", "a/both"),
        ],
        key=str,
    )
    assert licences.scanned(spark.createDataFrame([], FILES)).count() == 0


def test_cosines_are_those_of_tf_idf_vectors():
    import math
    from collections import Counter

    seen, n = {"mit": 3, "license": 50, "under": 70, "the": 90, "released": 5}, 100
    matcher = licences.Matcher({"MIT": licences.TEMPLATES["MIT"]}, seen, n)
    text = "Released under the MIT License, as is"
    idf = {w: math.log((1 + n) / (1 + c)) + 1 for w, c in seen.items()}
    a = {w: c * idf[w] for w, c in Counter("released under the mit license".split()).items()}
    b = {w: c * idf.get(w, math.log(1 + n) + 1) for w, c in Counter("released under the mit license as is".split()).items()}
    cosine = sum(a[w] * b[w] for w in a) / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))
    assert matcher.best(text)[1] == pytest.approx(cosine)
    # A notice broken over lines is found by its paragraph.
    assert matcher.best("prose\n\nReleased under\nthe MIT License.\n\nprose") == ("MIT", pytest.approx(1.0))


def test_several_passes_of_a_table_with_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k l"), (2, "nothing here")], "doc_id long, text string")
    docs = docs.withColumns({"parts": F.lit(1), "row": F.lit(2), "found": F.lit(3)})
    bench = spark.createDataFrame([("x", "b c d e f g h i j k"), ("y", "nothing")], "item_id string, text string")
    into = "hits"
    one = decontaminate.scanned(docs, bench, into=into).orderBy("doc_id").collect()
    many = decontaminate.scanned(docs, bench, into=into, broadcast_bytes=50).orderBy("doc_id").collect()
    assert one == many and [r[into]["items"] for r in one] == [["x"], ["y"]]
