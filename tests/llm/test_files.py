"""Tokens, packing, token-id files and WARC: round trips and brute force."""

import gzip
import hashlib
import io
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from corpus_helpers import extra
from pyspark.sql import functions as F

from tripledger.llm import id_file, packing, tokens, warc
from tripledger.llm.packing import Capacity
from tripledger.llm.tokens import Encoder

DOCS = "doc_id long, text string"
BYTE, WORD = "byte_bpe_50k.json", "word_bpe_49k.json"


def texts(n=60, seed=2):
    draw = random.Random(seed)
    pool = ["the", "Enê", "sch,", "ción.", "don't", "a.b", "3.14", "!!", "\n", "  ", "x<|endoftext|>", " ", "ß"]
    return [" ".join(draw.choice(pool) for _ in range(draw.choice([0, 1, 5, 40, 700]))) for _ in range(n)] + [None, "", "same", "same"]


def library_ids(path, text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", [BYTE, WORD])
def test_ids_are_those_of_the_library(tokenizer, name):
    draw = random.Random(1)
    alphabet = "ab é.,!'\n\t \r  \x1c\x0bÉ1<|endoftext|>ß́Σσ "
    many = ["".join(draw.choice(alphabet) for _ in range(draw.randrange(50))) for _ in range(1500)] + [t or "" for t in texts()]
    encoder = Encoder(tokenizer(name), remembered=300)  # pieces fall out of the memory
    want = [np.array(e.ids, "<u4").tobytes() for e in encoder.library.encode_batch(many, add_special_tokens=False)]
    assert encoder.encode(many) == want == encoder.encode(many)


@pytest.mark.parametrize(("name", "width", "alone"), [(BYTE, 4, "un,"), (WORD, 2, "un, x!! 12")])
def test_new_pieces_that_begin_with_a_blank_are_encoded_together(tokenizer, name, width, alone):
    encoder = Encoder(tokenizer(name), width=width)
    slow, each = [], encoder._each
    encoder._each = lambda pieces: slow.extend(pieces) or each(pieces)
    many = ["un, deux\n\nÉtés x!! 12 " + " ".join(f"{a}ou{b}è" for a in "abçdé" for b in "tuvßÿ")]
    assert encoder.encode(many) == [encoder.packed(encoder.library.encode(many[0], add_special_tokens=False).ids)]
    assert {p.strip() for p in slow} == {"un", ",", *alone.split()[1:]}


@pytest.mark.parametrize(("name", "remembered"), [(BYTE, packing.REMEMBERED), (WORD, tokens.REMEMBERED)])
def test_what_half_a_million_other_words_do_not_push_out(tokenizer, name, remembered):
    encoder = Encoder(tokenizer(name), remembered)
    sent, joined = [], encoder._joined
    encoder._joined = lambda pieces: sent.extend(pieces) or joined(pieces)
    letters = "abcdefghij"
    words = ["".join(letters[int(d)] for d in f"{k:06d}") for k in range(540_000)]
    for begin in range(0, len(words), 20_000):
        encoder.encode(["x " + " ".join(words[begin : begin + 20_000])])
    assert len(sent) == len(words)
    encoder.encode(["x " + " ".join(words[:20_000])])
    assert len(sent) == len(words)


# ---------------------------------------------------------------- packing


def checked(rows, capacity):
    """Sequences are gapless, keep every capacity and hold each piece once."""
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity.tokens and len(places) <= capacity.documents
        assert sum(n * n for _, n in places) <= capacity.cost
    return len(by_sequence)


CAPACITIES = [Capacity(), Capacity(64), Capacity(64, 3), Capacity(64, 64, 1500), Capacity(64, 4, 2000, (1, 2, 3), "dot")]


@pytest.mark.parametrize("capacity", CAPACITIES)
def test_packing_keeps_every_capacity_and_every_token(spark, tokenizer, capacity):
    docs = list(enumerate(texts())) + [(3, "same"), (None, "no id")]
    path = tokenizer(BYTE)
    found = packing.packed(extra(spark.createDataFrame(docs, DOCS)).repartition(3), path, 0, capacity, ids=True)
    rows = [r.asDict() for r in found.collect()]
    checked(rows, capacity)
    want = sorted((str(k), tuple([*library_ids(path, t), 0])) for k, t in docs)
    assert max(r["length"] for r in rows) <= capacity.longest
    pieces = sorted(rows, key=lambda r: (str(r["doc_id"]), r["start"]))
    whole = defaultdict(list)
    for r in pieces:
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        whole[str(r["doc_id"])] += np.frombuffer(r["ids"], "<u4").tolist()
    together = defaultdict(list)
    for k, ids in want:
        together[k] += list(ids)
    assert {k: sorted(v) for k, v in whole.items()} == {k: sorted(v) for k, v in together.items()}
    lengths = sorted((str(k), n) for k, t in docs for _, n in packing.cut(len(library_ids(path, t)) + 1, capacity.longest))
    assert sorted((str(r["doc_id"]), r["length"]) for r in rows) == lengths
    # The sequences themselves.
    by_id = {r.sequence_id: r for r in packing.sequences(found).collect()}
    for r in rows:
        ids = by_id[r["sequence_id"]].ids
        assert ids[4 * r["offset"] : 4 * (r["offset"] + r["length"])] == r["ids"]


def test_only_long_documents_are_cut_and_the_first_piece_is_the_short_one():
    assert packing.cut(2048, 2048) == [(0, 2048)] and packing.cut(1, 2048) == [(0, 1)]
    assert packing.cut(2049, 2048) == [(0, 1), (1, 2048)] and packing.cut(4096, 2048) == [(0, 2048), (2048, 2048)]


@pytest.mark.parametrize("capacity", CAPACITIES)
def test_plans_equal_best_fit_by_single_pieces_in_size(capacity):
    draw = random.Random(5)
    lengths = [draw.randrange(1, capacity.longest + 1) for _ in range(3000)] + [7] * 500
    histogram = {n: lengths.count(n) for n in set(lengths)}
    kinds = packing.plan(histogram, capacity)
    held = defaultdict(int)
    for kind in kinds:
        assert kind.count > 0 and sum(n * t for n, t in kind.holds) <= capacity.tokens
        assert sum(t for _, t in kind.holds) <= capacity.documents and sum(n * n * t for n, t in kind.holds) <= capacity.cost
        for n, t in kind.holds:
            held[n] += t * kind.count
    assert held == histogram and len(kinds) <= 2 * len(histogram) + 1
    bins = sum(k.count for k in kinds)
    least = max(sum(lengths) / capacity.tokens, len(lengths) / capacity.documents, sum(n * n for n in lengths) / capacity.cost)
    # Best fit decreasing one by one, for tokens alone: the plan needs no more bins.
    if capacity.documents >= 64 and capacity.cost >= capacity.tokens**2:
        room = []
        for n in sorted(lengths, reverse=True):
            fit = [k for k, x in enumerate(room) if x >= n]
            if fit:
                room[min(fit, key=lambda k: room[k])] -= n
            else:
                room.append(capacity.tokens - n)
        assert bins <= len(room) * 1.005 + 1
    assert bins >= least


def test_empty_tables_and_hot_lengths(spark, tokenizer):
    empty = spark.createDataFrame([], DOCS)
    assert packing.packed(empty, tokenizer(BYTE)).count() == 0
    assert id_file.read(id_file.write(empty, tokenizer(WORD))).count() == 0
    hot = spark.range(3000, numPartitions=6).select(F.col("id").alias("doc_id"), F.lit("one two three").alias("text"))
    rows = [r.asDict() for r in packing.packed(hot, tokenizer(BYTE)).collect()]
    assert checked(rows, Capacity()) == -(-3000 // (2048 // rows[0]["length"])) and len(rows) == 3000


# ---------------------------------------------------------------- token-id files


@pytest.mark.parametrize("values", [[], [0], [5], [0, 0, 0], list(range(1000)), [10**12], sorted(np.random.default_rng(1).integers(0, 10**9, 5000).tolist()), [3] * 700 + [10**6] * 700])
def test_elias_fano_round_trip(values):
    coded = id_file.Monotone.encode(np.array(values, np.uint64))
    file = io.BytesIO()
    about = coded.write(file)
    back = id_file.Monotone.read(file, about)
    assert back.slice(0, len(values)).tolist() == values
    draw = random.Random(1)
    for _ in range(200 if values else 0):
        k = draw.randrange(len(values))
        assert back.select(k) == values[k]
        assert back.slice(k, k + 9).tolist() == values[k : k + 9]
    if len(values) >= 1000:
        assert coded.size() < 8 * len(values) / 2  # far less than a table of 64-bit numbers
    with pytest.raises(IndexError):
        back.select(len(values))


@pytest.mark.parametrize("shards", [1, 4])
def test_files_give_every_document_back(spark, tokenizer, shards):
    path = tokenizer(WORD)
    docs = [(k * 7 - 50, t) for k, t in enumerate(texts())] + [(6, "repeated"), (6, "repeated"), (None, "no place")]
    files = id_file.write(extra(spark.createDataFrame(docs, DOCS)).repartition(5), path, shards=shards)
    found = sorted(tuple(r) for r in id_file.read(files).collect())
    want, start = [], 0
    for key, ids in sorted((k, [*library_ids(path, t), 2]) for k, t in docs if k is not None):
        want.append((key, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted((k, n, c) for k, _, n, c in found) == sorted(want)
    at = 0
    for _, begin, n, _ in sorted(found, key=lambda r: (r[0], r[1])):
        assert begin == at
        at += n
    assert at == start == sum(r.ids for r in files.collect())
    shard = id_file.Shard(files.orderBy("first_key").first().url)
    in_order = [ids.tolist() for _, _, ids in shard.documents()]
    assert [shard.document(k).tolist() for k in range(len(shard))] == in_order and shard.width == 2


# ---------------------------------------------------------------- WARC

PAGES = "page_id long, url string, html string"
BIG = "<p>" + "ñandú " * 40


def pages():
    rows = [(5, "http://a/5", BIG), (3, "http://a/3", BIG), (9, None, BIG), (1, "http://a/1", "short"), (2, "http://a/2", "short"),
            (7, "http://a/\r\n7 é", ""), (8, "http://a/8", None), (None, "http://a/x", BIG), (3, "http://a/3", BIG),
            (11, "u", "a" * 100), (12, "u", "a" * 100), (13, "u", "a" * 99), (14, "u", "a" * 99),
            (20, "u", "WARC/1.1\r\n\r\n" + "x" * 3_000_000)]
    return rows


def test_pages_come_back_from_the_archives(spark):
    rows = pages()
    found = warc.read_back(spark, warc.write(extra(spark.createDataFrame(rows, PAGES)).repartition(3), file_bytes=2000))
    first = {}
    for key, _, html in rows:
        if key is not None and len((html or "").encode()) >= 100:
            first[html] = min(key, first.get(html, key))
    want = []
    for key, _, html in rows:
        body = (html or "").encode()
        revisit = key is not None and len(body) >= 100 and first[html] < key
        want.append((key, len(body), hashlib.sha256(body).hexdigest(), "revisit" if revisit else "response", first[html] if revisit else None))
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
    assert found.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert warc.read_back(spark, warc.write(spark.createDataFrame([], PAGES))).count() == 0


def test_revisits_name_the_record_of_their_response(spark):
    files = [r.url for r in warc.write(spark.createDataFrame(pages(), PAGES).repartition(3)).collect()]
    found = warc.read(spark, files).collect()
    responses = {r.record_id: r for r in found if r.record_type == "response"}
    revisits = [r for r in found if r.record_type == "revisit"]
    assert len(revisits) == 3 and all(r.refers_to is None for r in responses.values())
    for r in revisits:
        named = responses[r.refers_to]
        assert (named.page_id, named.payload_digest) == (r.refers_to_page, r.payload_digest)
    raw = warc.page_record(7, "http://a/7", b"x", "d", 3, "2024-01-01T00:00:00Z", "http://a/3").decode()
    assert "WARC-Refers-To-Target-URI: http://a/3\r\n" in raw and "WARC-Refers-To-Date: 2024-01-01T00:00:00Z\r\n" in raw
    assert "Refers-To-Target-URI" not in warc.page_record(7, "http://a/7", b"x", "d", 3, "2024-01-01T00:00:00Z", None).decode()


def test_filters_are_pushed_down_and_bodies_skipped(spark):
    files = [r.url for r in warc.write(spark.createDataFrame(pages(), PAGES).coalesce(1)).collect()]
    found = warc.read(spark, files)
    assert found.where("record_type = 'revisit'").count() == 3 == found.where("record_type in ('revisit', 'metadata')").count()
    assert found.where("record_type = 'warcinfo'").count() == len(files)
    assert {r.page_id for r in found.where("target_uri is null and page_id is not null").collect()} == {"9"}
    assert [r.page_id for r in found.where("target_uri = 'http://a/5'").collect()] == ["5"]
    assert [r.page_id for r in found.where(F.col("target_uri").startswith("http://a/ 7")).collect()] == ["7"]
    bare = warc.read(spark, files, payload=False)
    sizes = {r.page_id: r.payload_length for r in bare.where("record_type = 'response'").collect()}
    assert sizes["5" if "5" in sizes else "3"] == len(BIG.encode()) and bare.where("payload is not null").count() == 0

    reader = warc.WarcReader(files, True)
    from pyspark.sql.datasource import EqualTo, GreaterThan

    left = list(reader.pushFilters([EqualTo(("record_type",), "revisit"), GreaterThan(("payload_length",), 5)]))
    assert len(left) == 1 and len(reader.filters) == 1
    inflated = []
    content = warc._Block.content
    try:
        warc._Block.content = lambda self: inflated.append(1) or content(self)
        assert len([r for p in reader.partitions() for r in reader.read(p)]) == 3
    finally:
        warc._Block.content = content
    assert len(inflated) == 3  # of fifteen records


def test_archives_are_plain_gzip_and_lengths_may_be_missing():
    one = warc.record({"WARC-Type": "response"}, b"x" * 5000)
    two = warc.record({"WARC-Type": "metadata"}, b"second")
    packed = warc.member(one)
    assert gzip.decompress(packed + warc.member(two)) == one + two
    for raw in (packed + warc.member(two), gzip.compress(one) + gzip.compress(two)):

        class Source(io.BytesIO):
            def size(self, n=len(raw)):
                return n

        found = [(h["warc-type"], b.content()) for h, b in warc.members(warc._Bytes(Source(raw)))]
        assert found == [("response", b"x" * 5000), ("metadata", b"second")]
        skipped = [h["warc-type"] for h, _ in warc.members(warc._Bytes(Source(raw)))]
        assert skipped == ["response", "metadata"]
