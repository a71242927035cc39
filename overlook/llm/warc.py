"""WARC: write records, read archives back, store payloads once by digest, rebuild records through joins.

Archives are written by Spark's text writer with the record separator as line separator, gzip-compressed, and read back
as binary files that a parser walks by Content-Length. In the content-addressed archive, payload bytes stand once under
their SHA-256, verified against the digest that the archive declares, and exact header bytes stand apart; a record is
headers joined to payload. Stored payloads are zstandard blocks, so that what the joins move is small; taken out, each is
verified again.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from overlook.llm.common import table
from overlook.plans.shared import cut, fresh_path, written

#: Payloads of fewer bytes are never deduplicated.
MIN_BYTES = 0
#: (bytes of a record at most, records in an archive file at most): what the reader of one file meets is bounded in bytes.
FILES = ((128 << 10, 2000), (4 << 20, 64), (1 << 62, 1))
DATE = "2024-01-01T00:00:00Z"
#: Revisits, and places of payloads that stand twice (about 100 bytes each), up to which they are broadcast; beyond, payloads are shuffled.
BROADCAST_ROWS = 100_000
#: Fixed values of the WARC/1.1 format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"


def base32_sha1(data: Column) -> Column:
    """SHA-1 in base32, upper case: 20 bits at a time through base 32 digits, then the alphabet of RFC 4648."""
    digest = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def record_uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("\n", *[F.coalesce(p.cast("string"), F.lit("~")) for p in parts]))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _named(pages: DataFrame) -> DataFrame:
    url = F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), "\r", "%0D"), "\n", "%0A")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("html"))
    return rows.withColumn("digest", base32_sha1(F.encode("html", "UTF-8"))).withColumn("size", F.octet_length("html").cast("long"))


def page_digests(pages: DataFrame) -> DataFrame:
    """``(page_id, digest, size)``: all that is needed to tell which page revisits which, read in one scan."""
    return cut(_named(pages).select("page_id", "digest", "size"))


def page_records(pages: DataFrame, min_bytes: int = MIN_BYTES, broadcast_rows: int = BROADCAST_ROWS, digests: DataFrame | None = None) -> DataFrame:
    """``(record)``: one WARC record a row of ``pages``, as text.

    A null html is an empty payload, a null url an empty URI; line breaks in a url are percent-encoded. Of equal payloads
    of ``min_bytes`` at least, the row with the largest page_id is the response and rows with a smaller page_id, or none,
    revisit it; rows that share that largest page_id are all responses. Only ids and digests are shuffled to find it. Up
    to ``broadcast_rows`` revisits are broadcast; beyond, payloads move once, by page_id and digest, so that copies of
    one payload spread.
    """
    named = _named(pages)
    ids = page_digests(pages) if digests is None else digests
    # cut off from its aggregate, so that the rows of one payload, however many, may be split where they meet it
    last = cut(ids.where(F.col("size") >= min_bytes).groupBy("digest", "size").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1 AND keeper IS NOT NULL"))
    revisits = (
        ids.join(last, ["digest", "size"]).where(F.col("page_id").isNull() | (F.col("page_id") < F.col("keeper"))).select(F.col("page_id").alias("rv_id"), F.col("digest").alias("rv_digest"), "keeper").distinct()
    )
    revisits = cut(revisits)
    if revisits.count() <= broadcast_rows:
        revisits = F.broadcast(revisits)
    whole = named.join(revisits, F.col("page_id").eqNullSafe(F.col("rv_id")) & (F.col("digest") == F.col("rv_digest")), "left")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=UTF-8{CRLF}Content-Length: "), F.col("size").cast("string"), F.lit(CRLF * 2))
    is_revisit = F.col("keeper").isNotNull()
    block = F.when(is_revisit, http).otherwise(F.concat(http, F.col("html")))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.when(is_revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", record_uuid(F.col("page_id"), F.col("digest"), F.when(is_revisit, "revisit").otherwise("response"))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(is_revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", record_uuid(F.col("keeper"), F.col("digest"), F.lit("response"))), line("WARC-Refers-To-Page", F.col("keeper").cast("string")))).otherwise(""),
        F.when(F.col("page_id").isNull(), "").otherwise(line("WARC-Page", F.col("page_id").cast("string"))),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
    )
    return whole.select(F.concat(head, F.lit(CRLF), block).alias("record"))


def write_archives(records: DataFrame, path: str, per_file: int | None = None, largest: int | None = None) -> None:
    """Write ``record`` (text or bytes cast to text) as gzip WARC files: a record ends with two line breaks.

    Records of each size class go to files of their own, fewer to a file the larger they are. ``largest``, the bytes of
    the largest record if known, saves the passes over classes that have none.
    """
    size, least = F.octet_length("record"), -1
    for most, count in FILES:
        if largest is not None and largest <= least:
            break
        own = records.where((size > least) & (size <= most))
        own.write.mode("append").option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", per_file or count).text(path)
        least = most


class _Stream:
    """Reads from gzip bytes piece by piece, or from plain bytes."""

    def __init__(self, raw: bytes):
        self.raw, self.at, self.zipped = memoryview(raw), 0, raw[:2] == b"\x1f\x8b"
        self.z = zlib.decompressobj(31)
        self.buffer = bytearray()
        self.broken = False

    def _more(self) -> bool:
        if self.at >= len(self.raw):
            return False
        piece = self.raw[self.at : self.at + 65536]
        if not self.zipped:
            self.at += len(piece)
            self.buffer += piece
            return True
        try:
            self.buffer += self.z.decompress(piece)
        except zlib.error:
            self.at, self.broken = len(self.raw), True
            return False
        self.at += len(piece)
        if self.z.eof:  # the next gzip member
            self.at -= len(self.z.unused_data)
            self.z = zlib.decompressobj(31)
        return True

    def until(self, mark: bytes) -> bytes | None:
        start = 0
        while (i := self.buffer.find(mark, start)) < 0:
            start = max(0, len(self.buffer) - len(mark))
            if not self._more():
                return None
        out = bytes(self.buffer[: i + len(mark)])
        del self.buffer[: i + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        """The next ``n`` bytes, or as many as there are."""
        while len(self.buffer) < n and self._more():
            pass
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        return out

    def rest(self) -> bytes:
        return self.take(1 << 62)


def parse_archive(raw: bytes) -> Iterator[tuple[int, bytes, bytes, bytes, str | None]]:
    """(position, header bytes, protocol bytes, payload bytes, error) of each record; lengths come from Content-Length alone.

    A record that is damaged still gives a row, with what there is of it and an error: ``no length`` (reading goes on at the next
    record mark), ``ends in header``, ``ends in block``, or ``not gzip`` where compressed bytes are broken.
    """
    stream, n = _Stream(raw), 0
    while True:
        head = stream.until(b"\r\n\r\n")
        if head is None:
            left = stream.rest()
            if left.strip() or stream.broken:
                yield n, left, b"", b"", "not gzip" if stream.broken else "ends in header"
            return
        found = re.search(rb"(?im)^content-length:[ \t]*(\d+)[ \t]*\r?$", head)
        if not found:
            yield n, head, b"", b"", "no length"
            if stream.until(b"\r\nWARC/") is None:
                return
            stream.buffer[:0] = b"WARC/"
        else:
            length = int(found[1])
            block = stream.take(length)
            error = None if len(block) == length else "not gzip" if stream.broken else "ends in block"
            split = block.find(b"\r\n\r\n") + 4 if re.search(rb"(?im)^content-type:[ \t]*application/http", head) and b"\r\n\r\n" in block else 0
            yield n, head, block[:split], block[split:], error
            if error:
                return
            stream.take(4)
        n += 1


PARTS = "file string, pos long, header binary, protocol binary, block binary, length long, sha256 string, sha1 string, error string"
_PARTS = pa.schema([("file", pa.string()), ("pos", pa.int64()), ("header", pa.binary()), ("protocol", pa.binary()), ("block", pa.binary()), ("length", pa.int64()), ("sha256", pa.string()), ("sha1", pa.string()), ("error", pa.string())])


def _parse_files(batches):
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        for name, raw in zip(batch.column("path"), batch.column("content")):
            rows, size = [], 0
            for n, head, protocol, payload, error in parse_archive(raw.as_py()):
                rows.append((name.as_py(), n, head, protocol, pack(payload), len(payload), hashlib.sha256(payload).hexdigest(), base64.b32encode(hashlib.sha1(payload).digest()).decode(), error))
                size += len(payload)
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _PARTS.types)], schema=_PARTS)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _PARTS.types)], schema=_PARTS)


def read_archives(spark, path: str) -> DataFrame:
    """The records of all archives below ``path``, plain or gzip, with digests computed from the bytes read.

    Payloads are packed as ``block``. A row of the file reader is a file; Arrow batches are bounded in bytes. What is wrong
    with a damaged record stands in ``error`` (see ``parse_archive``).
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_parse_files, PARTS)


def header(name: str, column: str = "header") -> Column:
    """A header's value, read one character a byte, so that bytes of any encoding can be read; null where there is none."""
    found = F.regexp_extract(F.decode(F.col(column), "ISO-8859-1"), rf"(?im)^{name}:[ \t]*([^\r\n]*)", 1)
    return F.when(found != "", found)


def content_store(records: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> tuple[DataFrame, DataFrame]:
    """(headers, payloads): exact header and protocol bytes a record, and payload bytes once by SHA-256.

    A record with a payload of its own points to that payload's SHA-256. A record that revisits another has none: it is
    resolved by the payload digest that it declares. A payload whose SHA-1 differs from the declared one is a damaged
    record, as is one with an ``error``: its ``verified`` is false and it never stands for another record.
    """
    declared = F.regexp_replace(header("WARC-Payload-Digest"), "^sha1:", "")
    parts = written(
        records.withColumns({"type": header("WARC-Type"), "declared": declared}).withColumn("verified", F.col("error").isNull() & ((F.col("type") == "revisit") | F.coalesce(F.col("declared") == F.col("sha1"), F.lit(True)))),
        "warc-parts",
    )
    own = F.coalesce(F.col("type") != "revisit", F.lit(True))
    headers = parts.select("file", "pos", "header", "protocol", "type", "verified", "error", F.coalesce("declared", "sha1").alias("digest"), F.when(own, F.col("sha256")).alias("sha256"))
    # archives that hold a payload twice are rare: the later places go, found without moving payloads
    kept = parts.where(own & F.col("verified"))
    places = kept.select("sha256", "file", "pos")
    first = places.groupBy("sha256").agg(F.min(F.struct("file", "pos")).alias("at"), F.count("*").alias("n")).where("n > 1")
    later = cut(places.join(first, "sha256").where(F.struct("file", "pos") != F.col("at")).select("file", "pos"))
    if later.count() <= broadcast_rows:
        later = F.broadcast(later)
    payloads = kept.join(later, ["file", "pos"], "left_anti").select("sha256", F.col("sha1").alias("digest"), "length", "block")
    return headers, payloads


def _unpack(names: list[str]):
    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            out = []
            for block, want in zip(b.column("block"), b.column("sha256")):
                payload = None if not block.is_valid else unpack(block.as_py())
                if payload is not None and hashlib.sha256(payload).hexdigest() != want.as_py():
                    raise ValueError(f"payload {want.as_py()} is damaged")
                out.append(payload)
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(out, pa.binary())], [*names, "payload"])

    return run


def rebuild(headers: DataFrame, payloads: DataFrame) -> DataFrame:
    """Records with ``payload`` again: each header row joined to its payload by digest; none where it is unknown.

    Two payloads with one SHA-1 but different SHA-256 would be told apart for responses by SHA-256; a revisit takes the
    smaller SHA-256 then.
    """
    by_sha1 = cut(payloads.groupBy("digest").agg(F.min("sha256").alias("rb_sha256")))  # as above: revisits of one payload may be many
    pointed = headers.join(by_sha1, "digest", "left").withColumn("rb_key", F.coalesce("sha256", "rb_sha256"))
    met = pointed.drop("sha256", "rb_sha256").join(payloads.drop("digest").withColumnRenamed("sha256", "rb_key"), "rb_key", "left").withColumnRenamed("rb_key", "sha256")
    names = [c for c in met.columns if c != "block"]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in met.schema if f.name != "block")
    return met.mapInArrow(_unpack(names), f"{kinds}, payload binary")


def op1_warc(spark, sf_dir):
    """Write a record for each row of ``pages``, read the archives back, store and rebuild, report each page."""
    path = fresh_path(spark, "warc")
    pages = table(spark, sf_dir, "pages")
    digests = page_digests(pages)
    largest = (digests.agg(F.max("size")).first()[0] or 0) + 16_384  # what headers may add, url aside
    urls = pages.agg(F.max(F.octet_length("url"))).first()[0] or 0
    write_archives(page_records(pages, digests=digests), path, largest=largest + 3 * urls)
    out = rebuild(*content_store(read_archives(spark, path)))
    revisit = F.col("type") == "revisit"
    return out.select(
        header("WARC-Page").cast("long").alias("page_id"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        base32_sha1(F.col("payload")).alias("payload_digest"),
        F.col("type").alias("record_type"),
        F.when(revisit, header("WARC-Refers-To-Page").cast("long")).alias("refers_to"),
    )


SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS s FROM p),
d AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
        1 + ((CAST('0x' || substr(s, 1 + 5 * CAST(i // 4 AS INT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31)]), '') AS payload_digest FROM h),
k AS (SELECT *, CASE WHEN payload_bytes >= {MIN_BYTES} THEN max(page_id) OVER (PARTITION BY payload_digest) END AS keeper FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN keeper IS NOT NULL AND (page_id IS NULL OR page_id < keeper) THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN keeper IS NOT NULL AND (page_id IS NULL OR page_id < keeper) THEN keeper END AS refers_to
FROM k
"""
