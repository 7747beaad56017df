"""Legacy archive conversion: ARC 1 and 2 to WARC 1.1, and reading both.

Archives are gzipped files in a shared folder, written by Spark's text writer, one bounded block of
records a file, and read back whole with ``binaryFile``. Records are cut out by their declared
lengths, whatever their payloads hold.

ARC files open with a ``filedesc`` record that declares the version; a version 1 header line has five
fields, a version 2 line ten, of which only the URL may hold spaces. Conversion synthesises what ARC
lacks: record ids from the record's identity, ISO timestamps from 14-digit dates, the record type,
and SHA-1 digests. Of the records with equal payloads of at least ``MIN_REVISIT`` bytes, the one
with the largest page id becomes a response, the others revisit it.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varistack.llm.common import checkpoint, shared_dir, slices, table

MIN_REVISIT = 1000
#: Bytes of records in one archive file (a larger record has a file of its own).
BLOCK_BYTES = 16 << 20
#: Rows (of about 100 bytes) up to which the table of shared digests is broadcast; beyond, the blocks are dealt by digest.
BROADCAST_ROWS = 200_000
SOFTWARE = "varistack"
ARC_DATE = "20240101000000"


def arc_file(records: list[tuple[bytes, str, bytes]], version: int, name: str) -> bytes:
    """An ARC file of ``(url, content type, block)`` records."""
    fields = b"URL IP-address Archive-date Content-type Archive-length"
    if version == 2:
        fields = b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"
    about = b"%d 0 %s\n%s\n" % (version, SOFTWARE.encode(), fields)
    extra = b" 200 - - 0 %s" % name.encode() if version == 2 else b""
    parts = [b"filedesc://%s 0.0.0.0 %s text/plain%s %d\n%s" % (name.encode(), ARC_DATE.encode(), extra, len(about), about)]
    for url, kind, block in records:
        extra = b" 200 %s - 0 %s" % (hashlib.sha1(block).hexdigest().encode(), name.encode()) if version == 2 else b""
        parts.append(b"%s 0.0.0.0 %s %s%s %d\n%s" % (url, ARC_DATE.encode(), kind.encode(), extra, len(block), block))
    return b"\n".join(parts)


def read_arc(data: bytes) -> Iterator[dict]:
    """Records of an ARC file: ``url, date, type, block``; the header's form is what the file declares."""
    at, version, opening = 0, 1, True
    while at < len(data):
        stop = data.index(b"\n", at)
        line = data[at:stop]
        if not line:
            at = stop + 1
            continue
        if opening and line.startswith(b"filedesc://"):  # the version block is a file's first record; later ones are pages
            size = int(line.rsplit(b" ", 1)[1])
            version = int(data[stop + 1 : stop + 1 + size].split(b" ", 1)[0]) if size else 1
            at, opening = stop + 1 + size, False
            continue
        opening = False
        url, *fields = line.rsplit(b" ", 4 if version == 1 else 9)
        size = int(fields[-1])
        if stop + 1 + size > len(data):
            raise ValueError("an ARC record ends before its declared length")
        yield {"url": url, "date": fields[1].decode(), "type": fields[2].decode(), "block": data[stop + 1 : stop + 1 + size]}
        at = stop + 1 + size


def iso_date(arc_date: str) -> str:
    d = arc_date.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(*identity) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ':'.join(map(str, identity)))}>"


def http_block(payload: bytes, page_id) -> bytes:
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n" % len(payload)
    if page_id is not None:
        head += b"X-Page-Id: %d\r\n" % page_id
    return head + b"\r\n" + payload


def split_http(block: bytes) -> tuple[bytes, dict[str, str], bytes]:
    head, _, payload = block.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode("latin-1").split("\r\n")[1:] if ": " in x)
    return head + b"\r\n\r\n", fields, payload


def warc_record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8", "surrogateescape")
    return b"WARC/1.1\r\n" + head + b"Content-Length: %d\r\n\r\n" % len(block) + block


def convert(arc: dict, response_id: int | None) -> bytes:
    """The WARC record of an ARC record; ``response_id`` is the page that a revisit refers to, else None."""
    head, http, payload = split_http(arc["block"])
    digest, url, page = hashlib.sha1(payload).hexdigest(), arc["url"].decode("utf-8", "surrogateescape"), http.get("X-Page-Id")
    block = head + payload if response_id is None else head
    fields = [
        ("WARC-Type", "response" if response_id is None else "revisit"),
        ("WARC-Record-ID", record_id("page", page, digest)),
        ("WARC-Date", iso_date(arc["date"])),
        ("WARC-Target-URI", url),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{hashlib.sha1(block).hexdigest()}"),
    ]
    if response_id is not None:
        fields += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", record_id("page", response_id, digest)),
            ("X-Refers-To-Page-Id", str(response_id)),
        ]
    return warc_record(fields, block)


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """``(header fields, block)`` of each record, cut by its Content-Length; digests are verified."""
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        lines = data[at:stop].decode("utf-8", "surrogateescape").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        size = int(fields["Content-Length"])
        block = data[stop + 4 : stop + 4 + size]
        if fields.get("WARC-Block-Digest", "").removeprefix("sha1:") not in ("", hashlib.sha1(block).hexdigest()):
            raise ValueError("a WARC block does not match its digest")
        yield fields, block
        at = stop + 4 + size
        while data[at : at + 2] == b"\r\n":
            at += 2


def _blocks(records: Iterator[tuple[int, object]], make) -> Iterator[pa.RecordBatch]:
    """Gather records of about ``BLOCK_BYTES`` into files; ``make`` turns a list into bytes."""
    own, size, number = [], 0, 0
    for n, record in records:
        if own and size + n > BLOCK_BYTES:
            yield pa.record_batch([pa.array([make(own, number)], pa.binary())], names=["value"])
            own, size, number = [], 0, number + 1
        own.append(record)
        size += n
    if own:
        yield pa.record_batch([pa.array([make(own, number)], pa.binary())], names=["value"])


def _write(blocks: DataFrame, path: str, separator: str) -> None:
    """One gzipped file per row: the row's bytes, then the separator that ends a record."""
    text = blocks.select(F.col("value").cast("string"))
    text.write.option("lineSep", separator).option("compression", "gzip").option("maxRecordsPerFile", 1).text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")


def _unzip(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
    for batch in batches:
        for content in batch.column(0):
            yield zlib.decompress(content.as_buffer(), 31)


def write_arc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write pages as ARC files, version 1 and 2 by turns. A null URL is ``-``, a null html an empty payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()

        def records():
            for batch in slices(batches, "html"):
                for page, url, html in zip(*(batch.column(i).to_pylist() for i in range(3))):
                    block = http_block((html or "").encode("utf-8", "surrogatepass"), page)
                    clean = (url or "-").replace("\n", "%0A").replace("\r", "%0D").encode("utf-8", "surrogatepass")
                    yield len(block) + len(clean) + 100, (clean, "text/html", block)

        yield from _blocks(records(), lambda own, n: arc_file(own, 1 + (part + n) % 2, f"pages-{part}-{n}.arc"))

    picked = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    _write(picked.mapInArrow(run, "value binary"), path, "\n")


def convert_arc(spark: SparkSession, arc_path: str, warc_path: str, min_revisit: int = MIN_REVISIT) -> None:
    """Convert a folder of ARC files into a folder of WARC files."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data in _unzip(batches):
            rows = []
            for arc in read_arc(data):
                _, http, payload = split_http(arc["block"])
                if len(payload) >= min_revisit and "X-Page-Id" in http:
                    rows.append((hashlib.sha1(payload).hexdigest(), int(http["X-Page-Id"])))
            yield pa.record_batch([pa.array([d for d, _ in rows], pa.string()), pa.array([p for _, p in rows], pa.int64())], names=["digest", "page"])

    seen = _files(spark, arc_path).mapInArrow(digests, "digest string, page long")
    shared = seen.groupBy("digest").agg(F.max("page").alias("response"), F.count("*").alias("n")).where("n > 1").select("digest", "response")
    shared = checkpoint(shared)  # known before the blocks are dealt, which stay where they are if it is small
    small = shared.count() <= BROADCAST_ROWS

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data in _unzip(batches):
            rows: list[tuple] = []
            size = 0
            for arc in read_arc(data):
                _, http, payload = split_http(arc["block"])
                page = int(http["X-Page-Id"]) if "X-Page-Id" in http else None
                # small payloads and pages without an id revisit nothing: a key of their own, not one for all
                digest = hashlib.sha1(payload).hexdigest() if page is not None and len(payload) >= min_revisit else f"-{page}-{len(rows)}"
                rows.append((digest, page, arc["url"], arc["date"], arc["block"]))
                size += len(arc["block"])
                if size > BLOCK_BYTES // 4:
                    yield _arc_rows(rows)
                    rows, size = [], 0
            if rows:
                yield _arc_rows(rows)

    parsed = _files(spark, arc_path).mapInArrow(parse, "digest string, page long, url binary, date string, block binary")
    paired = parsed.join(F.broadcast(shared) if small else shared, "digest", "left")
    # a page is the response if it has the group's largest id; a page without an id never revisits
    decided = paired.select("page", "url", "date", "block", F.when(F.col("page") < F.col("response"), F.col("response")).alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records():
            for batch in slices(batches, "block"):
                for url, date, block, refers in zip(*(batch.column(i).to_pylist() for i in range(1, 5))):
                    record = convert({"url": url, "date": date, "block": block}, refers)
                    yield len(record), record

        def make(own: list[bytes], number: int) -> bytes:
            about = f"software: {SOFTWARE}\r\nformat: WARC File Format 1.1\r\n".encode()
            info = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id("info", hashlib.sha1(own[0]).hexdigest(), len(own))), ("WARC-Date", iso_date(ARC_DATE)), ("Content-Type", "application/warc-fields")]
            return b"\r\n\r\n".join([warc_record(info, about), *own])

        yield from _blocks(records(), make)

    _write(decided.mapInArrow(write, "value binary"), warc_path, "\r\n\r\n")


def _arc_rows(rows: list[tuple]) -> pa.RecordBatch:
    digest, page, url, date, block = zip(*rows)
    return pa.record_batch([pa.array(digest, pa.string()), pa.array(page, pa.int64()), pa.array(url, pa.binary()), pa.array(date), pa.array(block, pa.binary())], names=["digest", "page", "url", "date", "block"])


def read_records(spark: SparkSession, warc_path: str) -> DataFrame:
    """``(page_id, url, record_id, record_type, date, payload_bytes, payload_digest, refers_to)`` of the
    response and revisit records of a folder of WARC files. A response's digest is that of its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data in _unzip(batches):
            rows = []
            for fields, block in read_warc(data):
                kind = fields["WARC-Type"]
                if kind not in ("response", "revisit"):
                    continue
                _, http, payload = split_http(block)
                digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                    raise ValueError("a WARC payload does not match its digest")
                refers = fields.get("X-Refers-To-Page-Id")
                size = len(payload) if kind == "response" else int(http["Content-Length"])
                page = http.get("X-Page-Id")
                rows.append((int(page) if page is not None else None, fields["WARC-Target-URI"], fields["WARC-Record-ID"], kind, fields["WARC-Date"], size, digest, int(refers) if refers else None))
            columns = list(zip(*rows)) if rows else [[]] * 8
            kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=["page_id", "url", "record_id", "record_type", "date", "payload_bytes", "payload_digest", "refers_to"])

    return _files(spark, warc_path).mapInArrow(run, "page_id long, url string, record_id string, record_type string, date string, payload_bytes long, payload_digest string, refers_to long")


def archive(pages: DataFrame, folder: str, **columns) -> DataFrame:
    """Write pages as ARC, convert to WARC, and read the records back; see :func:`read_records`.

    Every row has its record: null URLs are ``-``, null html is empty, null ids stay null. Rows that
    repeat the largest page id of a group are all responses. An empty table gives an empty result.
    """
    spark = pages.sparkSession
    write_arc(pages, f"{folder}/arc", **columns)
    schema = "page_id long, url string, record_id string, record_type string, date string, payload_bytes long, payload_digest string, refers_to long"
    if not _files(spark, f"{folder}/arc").limit(1).count():
        return spark.createDataFrame([], schema)
    convert_arc(spark, f"{folder}/arc", f"{folder}/warc")
    return read_records(spark, f"{folder}/warc")


def op9_warc(spark, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    found = archive(table(spark, sf_dir, "pages"), folder)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = f"""WITH sized AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS size FROM pages),
grouped AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS largest FROM sized)
SELECT page_id, size::BIGINT AS payload_bytes, sha1(html) AS payload_digest,
  CASE WHEN size >= {MIN_REVISIT} AND page_id < largest THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN size >= {MIN_REVISIT} AND page_id < largest THEN largest END AS refers_to FROM grouped"""
