"""Terms that disclose an entity: few documents, whole documents."""

import math
import random
import re
from collections import Counter

from tripledger.llm import disclosure

DOCS = "doc_id long, text string"
COMMON = [a + b + c for a in ("ba", "ko", "mi") for b in ("re", "su") for c in ("lan", "tov")]


def prose(seed, words=30):
    return " ".join(random.Random(seed).choices(COMMON, k=words))


def once():
    """700 documents; two have an address of their own, beside a name that is nowhere else."""
    rows = [(k, prose(k)) for k in range(698)]
    return rows + [(1300, f"{prose(1)} Zarathustra z@one.example {prose(2)}"), (1301, f"{prose(3)} Quetzal q@two.example {prose(4)}")]


def test_an_entity_of_one_document_is_judged(spark):
    docs = spark.createDataFrame(once(), DOCS)
    texts = {r.doc_id: r.text for r in disclosure.sanitised(docs).collect()}
    assert "Zarathustra" not in texts[1300] and "Quetzal" not in texts[1301]
    assert all(w in texts[1300] for w in prose(1).split()) and all(texts[k] == t for k, t in once()[:698])


def test_a_term_far_from_its_entity_goes_everywhere_in_the_document(spark):
    rows = [(k, prose(k)) for k in range(698)]
    rows.append((1300, f"Zarathustra {prose(1, 200)} z@one.example {prose(2, 200)} ZARATHUSTRA wrote {prose(5)} zarathustra"))
    # One that always comes with the entity, at a distance and in several documents.
    rows += [(1310 + k, f"Quetzal {prose(400 + k, 100)} q@two.example {prose(500 + k)}") for k in range(4)]
    docs = spark.createDataFrame(rows, DOCS)
    texts = {r.doc_id: r.text for r in disclosure.sanitised(docs).collect()}
    assert not re.search("zarathustra", texts[1300], re.I) and texts[1300].count("[EMAIL]") == 1
    assert not any("Quetzal" in texts[1310 + k] for k in range(4))
    assert all(texts[k] == t for k, t in rows[:698])


def test_terms_equal_a_plain_count(spark):
    dice = random.Random(7)
    rare = [f"rare{chr(97 + k)}" for k in range(12)]
    people = {f"p{k}@h.example": f"name{chr(97 + k)}" for k in range(8)}
    rows = []
    for k in range(250):
        words = prose(1000 + k, 12).split() + dice.choices(rare, k=dice.choice([0, 0, 1]))
        if dice.random() < 0.08:
            for e in dice.sample(sorted(people), dice.choice([1, 1, 2])):
                words += [e, *[people[e]] * dice.choice([0, 1, 1, 2, 2])]
        dice.shuffle(words)
        rows.append((k, " ".join(words)))
    n, how = len(rows), disclosure.Disclosure()
    terms = [set(re.findall(r"[a-z]{3,}", re.sub(r"\S+@\S+", " ", t))) for _, t in rows]
    every = Counter(w for _, t in rows for w in set(re.findall(r"[a-z]{3,}", t)))
    want = {}
    for k, text in rows:
        for e in set(re.findall(r"\S+@\S+", text)):
            with_it = [j for j, t in rows if e in t.split()]
            for w in terms[k]:
                both, n_t, q = sum(w in terms[j] for j in with_it), every[w], len(with_it) / n
                share = math.log(both / n_t / q) / math.log(1 / q)
                apart = n_t - both
                evidence = both * math.log(both / n_t / q) + (apart * math.log(apart / n_t / (1 - q)) if apart else 0)
                if share >= how.generalise and evidence >= -math.log(how.chance):
                    want.setdefault(k, set()).add(w)
    assert want
    spans = {r.doc_id: r.spans for r in disclosure.report(spark.createDataFrame(rows, DOCS)).collect()}
    for k, text in rows:
        found = [s.split(":") for s in spans[k].split(",") if s.startswith("term:")]
        found = [(int(a), int(b)) for _, a, b in found]
        told = [m.span() for m in re.finditer("[a-z]{3,}", text) if m.group() in want.get(k, ())]
        addresses = [m.span() for m in re.finditer(r"\S+@\S+", text)]
        assert found == [x for x in told if not any(x[0] < b and a < x[1] for a, b in addresses)]


def plainly_disclosed(rows, how):
    """Terms to go by document, counted with plain loops; texts hold lower-case words and addresses."""
    words = {k: set(re.findall("[a-z]{3,}", t)) for k, t in rows}
    beside = {k: set(re.findall("[a-z]{3,}", re.sub(r"\S+@\S+", " ", t))) for k, t in rows}
    held = {}
    for k, t in rows:
        for e in set(re.findall(r"\S+@\S+", t)):
            held.setdefault(e, set()).add(k)
    every = Counter(w for ws in words.values() for w in ws)
    alike, total = Counter(every.values()), sum(every.values())

    def bound(both, n, q):
        apart = n - both
        return both * math.log(both / n / q) + (apart * math.log(apart / n / (1 - q)) if apart else 0)

    want = {}
    for with_it in held.values():
        q, part = len(with_it) / len(rows), sum(len(beside[k]) for k in with_it) / total
        found = {}
        for w in set().union(*[beside[k] for k in with_it]):
            both, n = sum(w in beside[k] for k in with_it), every[w]
            if math.log(both / n / q) / -math.log(q) >= how.generalise and bound(both, n, q) >= -math.log(how.chance):
                found.setdefault((n, both), set()).add(w)
        for (n, both), some in found.items():
            expected = alike[n] * (math.exp(-bound(both, n, part)) if both / n > part else 1)
            if expected <= how.ordinary * len(some):
                for k in with_it:
                    want.setdefault(k, set()).update(some & words[k])
    return {k: ws for k, ws in want.items() if ws}


def letters(k):
    return "".join(chr(97 + int(c)) for c in f"{k:06d}")


def test_ordinary_words_that_occur_once_stay_and_names_go(spark):
    rows = [(k, f"{prose(k)} sole{letters(2 * k)} sole{letters(2 * k + 1)}") for k in range(900)]
    rows[7] = (7, rows[7][1] + " z@one.example")  # two words of its own, as any document has
    for k in (20, 21, 22):
        rows[k] = (k, f"{rows[k][1]} quetzal q@two.example")
    rows[40] = (40, " ".join([rows[40][1], "p@three.example", *[f"alias{letters(k)}" for k in range(90)]]))
    how = disclosure.Disclosure()
    want = plainly_disclosed(rows, how)
    assert 7 not in want and want[20] == {"quetzal"} and len(want[40]) == 92
    found = {r.doc_id: r.spans for r in disclosure.report(spark.createDataFrame(rows, DOCS)).collect()}
    for k, text in rows:
        spans = [tuple(map(int, s.split(":")[1:])) for s in found[k].split(",") if s.startswith("term:")]
        assert {text[a:b] for a, b in spans} == want.get(k, set()), k
    looser = disclosure.Disclosure(ordinary=1e9)  # the criterion alone keeps them
    assert "term:" in {r.doc_id: r.spans for r in disclosure.report(spark.createDataFrame(rows, DOCS), looser).collect()}[7]
