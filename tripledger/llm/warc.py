"""WARC archives: a writer with revisit records, and a Python data source that reads them.

Writing. Pages are written as WARC/1.1 ``response`` records with an HTTP head and the page as its body.
Of pages with equal bodies of at least ``SMALLEST_REVISIT`` bytes, the one with the least ``page_id`` is the
response and the others become ``revisit`` records without a body, which name it. Each record is one
gzip member with the ``sl`` extra field (compressed and uncompressed length), so a reader can go to
the next record without inflating this one. Files are rolled at ``FILE_BYTES``. Tasks write them below the
shared folder under names of their own; only files that a finished task names are ever read.

Reading. ``warc`` is a data source: it plans one partition per file, takes filters on the record type
and on other header columns, and applies them to the headers of a record before anything else of it is
looked at. Of a record that fails, only the first bytes are inflated and the body is skipped. With
``payload=false`` no body is decoded at all.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull,
    StringContains, StringEndsWith, StringStartsWith,
)
from pyspark.sql.types import StructType

from tripledger.llm.common import stored
from tripledger.session import work_folder

SMALLEST_REVISIT = 100
FILE_BYTES = 1 << 30
#: Bytes read at once from a file.
READ_BYTES = 1 << 20
SAME_BODY = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Column -> WARC header. ``page_id`` and ``refers_to_page`` are named fields of this writer.
HEADERS = {
    "record_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "target_uri": "WARC-Target-URI",
    "date": "WARC-Date",
    "payload_digest": "WARC-Payload-Digest",
    "refers_to": "WARC-Refers-To",
    "page_id": "Page-ID",
    "refers_to_page": "Refers-To-Page-ID",
}
SCHEMA = ", ".join(f"{c} string" for c in HEADERS) + ", payload_length long, payload binary"


def _open(url: str, write: bool = False):
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(url)
    return system.open_output_stream(path, compression=None) if write else system.open_input_file(path)


# ---------------------------------------------------------------- one record


def _clean(value: str) -> str:
    """A header value on one line."""
    return " ".join(value.split())


def record(headers: dict[str, str | None], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {_clean(v)}" for k, v in headers.items() if v is not None)]
    head = "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode("utf-8", "replace")
    return head + block + b"\r\n\r\n"


def member(raw: bytes) -> bytes:
    """A gzip member that tells its lengths; zeros if they need more than 32 bits."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(raw) + packer.flush()
    total = 10 + 2 + 12 + len(body) + 8
    lengths = (total, len(raw)) if max(total, len(raw)) < 1 << 32 else (0, 0)
    extra = b"sl" + struct.pack("<HII", 8, *lengths)
    head = b"\x1f\x8b\x08\x04" + b"\0" * 4 + b"\0\xff" + struct.pack("<H", len(extra)) + extra
    return head + body + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


def _named(page_id: int | None, url: str | None, digest: str) -> str:
    about = json.dumps([page_id, url, digest])
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, about)}>"


def page_record(
    page_id: int | None, url: str | None, body: bytes, digest: str, first: int | None, date: str, first_url: str | None = None
) -> bytes:
    """A response, or with ``first`` a revisit of that page's record, which had ``first_url``."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    headers = {
        "WARC-Type": "response" if first is None else "revisit",
        "WARC-Record-ID": _named(page_id, url, digest),
        "WARC-Date": date,
        "WARC-Target-URI": url,
        "WARC-Payload-Digest": f"sha256:{digest}",
        "Content-Type": "application/http; msgtype=response",
        "Page-ID": None if page_id is None else str(page_id),
    }
    if first is not None:
        headers |= {
            "WARC-Profile": SAME_BODY,
            "WARC-Refers-To": _named(first, first_url, digest),
            "WARC-Refers-To-Target-URI": first_url,
            "WARC-Refers-To-Date": date,
            "Refers-To-Page-ID": str(first),
        }
    return record(headers, http if first is not None else http + body)


# ---------------------------------------------------------------- writing


def with_firsts(pages: DataFrame, smallest: int = SMALLEST_REVISIT) -> DataFrame:
    """``page_id``, ``url``, ``body``, ``digest`` and, where the page revisits another, ``first`` and ``first_url``.

    Every row that carries the least ``page_id`` of its body is a response, and so are rows without ``page_id``. Of several such
    rows with different URLs, revisits name the least URL, null before others.
    """
    body = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("body"))
    rows = rows.withColumn("digest", F.sha2("body", 256))
    keyed = rows.where((F.octet_length("body") >= smallest) & F.col("page_id").isNotNull())
    firsts = keyed.groupBy("digest").agg(F.min(F.struct("page_id", "url")).alias("first"), F.count("*").alias("copies"))
    # Stored, so that the join below shuffles plain rows and a body with very many copies can be split.
    told = [F.col("first.page_id").alias("first"), F.col("first.url").alias("first_url")]
    firsts = stored(firsts.where("copies > 1").select("digest", *told), "first-pages")
    again = F.col("first") < F.col("page_id")
    named = [F.when(again, F.col(c)).alias(c) for c in ("first", "first_url")]
    return rows.join(firsts, "digest", "left").select("page_id", "url", "body", "digest", *named)


def write(pages: DataFrame, date: str = "2024-01-01T00:00:00Z", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes the archives and gives the stored list of them: ``url``, ``records``, ``bytes``.

    A null page is an empty body, a null ``url`` a record without target URI; white space in a URL becomes
    one blank, as a header is one line. Rows without ``page_id`` are responses without that field; repeated
    rows are written as often as they come. An empty table gives no files; other columns are left out.
    """
    folder = work_folder(pages.sparkSession, "warc")

    def written(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, done, url, size, records = None, [], "", 0, 0
        for batch in batches:
            columns = (batch[c].tolist() for c in ("page_id", "url", "body", "digest", "first", "first_url"))
            for page_id, target, body, digest, first, first_url in zip(*columns, strict=True):
                if out is None:
                    url, size, records = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = _open(url, write=True)
                    about = record({"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": date, "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n")
                    out.write(member(about))
                packed = member(page_record(_number(page_id), _text(target), bytes(body), digest, _number(first), date, _text(first_url)))
                out.write(packed)
                size, records = size + len(packed), records + 1
                if size >= file_bytes:
                    out.close()
                    done.append((url, records, size))
                    out = None
        if out is not None:
            out.close()
            done.append((url, records, size))
        yield pd.DataFrame(done, columns=["url", "records", "bytes"])

    # Ids as text: pandas would make a column with nulls one of floating-point numbers.
    rows = with_firsts(pages).withColumns({c: F.col(c).cast("string") for c in ("page_id", "first")})
    return stored(rows.mapInPandas(written, "url string, records long, bytes long"), "archives")


def _number(value) -> int | None:
    return None if value is None else int(value)


def _text(value) -> str | None:
    return value if isinstance(value, str) else None


# ---------------------------------------------------------------- reading


class _Bytes:
    """A file read in large stretches, with skips."""

    def __init__(self, source):
        self.source, self.size = source, source.size()
        self.at, self.buffer, self.begin = 0, b"", 0

    def peek(self, n: int) -> bytes:
        a = self.at - self.begin
        if a < 0 or a + n > len(self.buffer):
            self.source.seek(self.at)
            self.buffer, self.begin, a = self.source.read(max(n, READ_BYTES)), self.at, 0
        return self.buffer[a : a + n]

    def take(self, n: int) -> bytes:
        found = self.peek(n)
        self.at += len(found)
        return found


def _head(raw: bytes) -> tuple[dict[str, str], int] | None:
    """Header fields by lower-case name, and where the block begins; None if the head is not whole."""
    end = raw.find(b"\r\n\r\n")
    if end < 0:
        return None
    lines = raw[:end].decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    pairs = (line.split(":", 1) for line in lines[1:] if ":" in line)
    return {k.strip().lower(): v.strip() for k, v in pairs}, end + 4


def members(file: _Bytes) -> Iterator[tuple[dict[str, str], _Block]]:
    """The records' heads; bodies are inflated only on demand."""
    while file.at < file.size:
        begin = file.at
        start = file.peek(24)
        total = 0
        if start[:4] == b"\x1f\x8b\x08\x04" and start[12:14] == b"sl":
            total = struct.unpack("<I", start[16:20])[0]
        block = _Block(file, begin, total)
        yield block.headers, block
        file.at = begin + total if total else block.end()


class _Block:
    def __init__(self, file: _Bytes, begin: int, total: int):
        self.file, self.begin, self.total = file, begin, total
        self.inflater = zlib.decompressobj(31)
        self.raw = b""
        self.headers, self.start = self._until_head()

    def _more(self, most: int) -> bool:
        """Inflates some more; False at the member's end."""
        if self.inflater.eof:
            return False
        waiting = self.inflater.unconsumed_tail
        given = waiting or self.file.take(min(READ_BYTES, max(most, 512)))
        if not given:
            raise ValueError("the file ends within a record")
        self.raw += self.inflater.decompress(given, most)
        return True

    def _until_head(self) -> tuple[dict[str, str], int]:
        while (found := _head(self.raw)) is None:
            if not self._more(1024):
                raise ValueError("a record without a head")
        return found

    def prefix(self) -> bytes:
        """The block up to the end of its HTTP head, and a little more."""
        while b"\r\n\r\n" not in self.raw[self.start :] and self._more(1024):
            pass
        return self.raw[self.start :]

    def content(self) -> bytes:
        """The block, inflated whole."""
        length = int(self.headers["content-length"])
        parts = [self.raw]
        size = len(self.raw)
        while size < self.start + length and not self.inflater.eof:
            self.raw = b""
            self._more(READ_BYTES)
            parts.append(self.raw)
            size += len(self.raw)
        return b"".join(parts)[self.start : self.start + length]

    def end(self) -> int:
        """Where the next member begins, for files that do not tell lengths."""
        while not self.inflater.eof:
            self.raw = b""
            self._more(READ_BYTES)
        return self.file.at - len(self.inflater.unused_data)


@dataclass
class WarcFile(InputPartition):
    url: str


def _passes(f: Filter, value: str | None) -> bool:
    if isinstance(f, IsNull):
        return value is None
    if isinstance(f, EqualNullSafe):
        return value == f.value
    if value is None:
        return False
    if isinstance(f, EqualTo):
        return value == f.value
    if isinstance(f, In):
        return value in f.value
    if isinstance(f, StringStartsWith):
        return value.startswith(f.value)
    if isinstance(f, StringEndsWith):
        return value.endswith(f.value)
    if isinstance(f, StringContains):
        return f.value in value
    return True  # IsNotNull


class WarcReader(DataSourceReader):
    def __init__(self, files: list[str], payload: bool):
        self.files, self.payload = files, payload
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes what the header columns decide; Spark evaluates the rest."""
        kinds = (EqualTo, EqualNullSafe, In, IsNull, IsNotNull, StringStartsWith, StringEndsWith, StringContains)
        for f in filters:
            if isinstance(f, kinds) and len(f.attribute) == 1 and f.attribute[0] in HEADERS:
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        return [WarcFile(url) for url in self.files]

    def read(self, partition: WarcFile) -> Iterator[tuple]:
        names = list(HEADERS)
        for headers, block in members(_Bytes(_open(partition.url))):
            values = [headers.get(HEADERS[c].lower()) for c in names]
            if not all(_passes(f, values[names.index(f.attribute[0])]) for f in self.filters):
                continue
            length, body = None, None
            if headers.get("content-type", "").startswith("application/http"):
                content = block.content() if self.payload else block.prefix()
                head, found, body = content.partition(b"\r\n\r\n")
                for line in head.split(b"\r\n")[1:]:
                    if line[:15].lower() == b"content-length:":
                        length = int(line[15:])
                if not found or not self.payload or headers.get("warc-type") == "revisit":
                    body = None
            elif self.payload:
                body = block.content()
            yield (*values, length if length is not None else int(headers["content-length"]), body)


class WarcSource(DataSource):
    """``spark.read.format("warc")``; option ``files``: a JSON list of URLs, ``payload``: true or false."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(json.loads(self.options["files"]), self.options.get("payload", "true").lower() == "true")


def read(spark: SparkSession, files: list[str], payload: bool = True) -> DataFrame:
    """The records of the files. Filters reach them only with ``spark.sql.python.filterPushdown.enabled``, which is read when the
    query runs, after this function, and is therefore set for the whole session."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    options = {"files": json.dumps(files), "payload": str(payload).lower()}
    return spark.read.format("warc").options(**options).load()


def read_back(spark: SparkSession, archives: DataFrame) -> DataFrame:
    """Per page what the archives say: type, size and digest (of the body itself where there is one)."""
    # One short line per file of up to a gigabyte.
    files = [r["url"] for r in archives.select("url").collect()]
    if not files:
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    found = read(spark, files).where(F.col("record_type").isin("response", "revisit"))
    own = F.sha2("payload", 256)
    told = F.regexp_replace("payload_digest", "^sha256:", "")
    return found.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.coalesce(F.octet_length("payload"), F.col("payload_length")).cast("long").alias("payload_bytes"),
        F.coalesce(own, told).alias("payload_digest"),
        "record_type",
        F.col("refers_to_page").cast("long").alias("refers_to"),
    )


def digest(body: bytes) -> str:
    return hashlib.sha256(body).hexdigest()
