"""WARC archives with revisit resolution.

Only headers (record id, payload digest, payload size) are shuffled by digest: the smallest id of a digest keeps the payload and
is the response; the others become revisit records that refer to it. Archives are written and read by Spark itself, so any store
that Spark reaches will do: the text writer ends each record with the blank line that WARC asks for.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import Scratch, table

RECORD_END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
RECORDS_PER_FILE = 4000
#: What a file's records come to before compression, by their mean size.
FILE_BYTES = 1 << 28
CHUNK = 1 << 16
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def headers(pages: DataFrame) -> DataFrame:
    """(page_id, digest, size, h) of each row's payload, the html in UTF-8; h is a 64-bit hash of it."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            payloads = [(x.as_py() or "").encode() for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array([digest_of(x) for x in payloads], pa.string()), pa.array([len(x) for x in payloads], pa.int64()), batch.column("h")], names=["page_id", "digest", "size", "h"])

    slim = pages.select(F.col("page_id").cast("long"), "html", F.xxhash64(F.coalesce("html", F.lit(""))).alias("h"))
    return slim.mapInArrow(run, "page_id long, digest string, size long, h long")


def resolve(heads: DataFrame, scratch: Scratch, least: int = 0) -> DataFrame:
    """heads with original: the response that a record revisits, null for responses. Payloads under least bytes are all responses."""
    first = scratch.keep(heads.where((F.col("size") >= least) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.min("page_id").alias("first")), "first")
    joined = heads.join(first, "digest", "left")
    revisits = (F.col("size") >= least) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "digest", "size", "h", F.when(revisits, F.col("first")).alias("original"))


def _url(url: str | None) -> str:
    return quote(url or "", safe="%/:?#[]@!$&'()*+,;=~-._")


def _record(page: int | None, url: str | None, payload: str, digest: str, size: int, original: int | None) -> str:
    """A whole record without the blank line after it."""
    http = HTTP + f"Content-Length: {size}\r\n\r\n"
    body = http + payload if original is None else http
    name = "" if page is None else page
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if original is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{name}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_url(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if original is not None:
        lines += [f"WARC-Refers-To: <urn:page:{original}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join([*lines, f"Content-Length: {len(body.encode())}", "", body])


def write_archives(pages: DataFrame, resolved: DataFrame, path: str) -> None:
    """Gzip-compressed archives of about FILE_BYTES, by the mean record, and RECORDS_PER_FILE records at most, each record with fresh headers."""
    mean = resolved.agg(F.avg(F.when(F.col("original").isNull(), F.col("size")).otherwise(0))).first()[0] or 0
    per_file = int(max(1, min(RECORDS_PER_FILE, FILE_BYTES // (mean + 512))))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            d = batch.to_pydict()
            rows = zip(*(d[c] for c in ("page_id", "url", "html", "digest", "size", "original")), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([_record(p, u, h or "", g, n, o) for p, u, h, g, n, o in rows], pa.large_string()).cast(pa.string())], names=["value"])

    # equal page_ids with unlike payloads are told apart by the hash of the payload
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.xxhash64(F.coalesce("html", F.lit(""))).alias("h"))
    named = resolved.dropDuplicates(["page_id", "digest"]).withColumnRenamed("page_id", "id").withColumnRenamed("h", "h2")
    rows = keyed.join(named, F.col("page_id").eqNullSafe(F.col("id")) & (F.col("h") == F.col("h2")))
    rows.select("page_id", "url", "html", "digest", "size", "original").mapInArrow(run, "value string").write.option("lineSep", RECORD_END).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


class _Inflated:
    """The bytes of a gzip archive of any number of members, inflated a chunk at a time as they are asked for."""

    def __init__(self, packed: bytes):
        self.packed, self.at, self.inflate, self.held = memoryview(packed), 0, zlib.decompressobj(31), bytearray()

    def more(self) -> bool:
        if self.inflate.eof:
            self.at -= len(self.inflate.unused_data)
            self.inflate = zlib.decompressobj(31)
        waiting = self.inflate.unconsumed_tail
        if not waiting:
            waiting = self.packed[self.at : self.at + CHUNK]
            self.at += len(waiting)
        if not waiting:
            return False
        self.held += self.inflate.decompress(waiting, CHUNK)
        return True

    def upto(self, mark: bytes) -> bytes | None:
        """The bytes before the mark, which go as well; None at the end."""
        seen = 0
        while (i := self.held.find(mark, seen)) < 0:
            seen = max(0, len(self.held) - len(mark) + 1)
            if not self.more():
                if self.held:
                    raise ValueError("the archive ends within a record's header")
                return None
        return self.take(i + len(mark))[:i]

    def take(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self.more():
                raise ValueError("the archive ends within a record")
        out = bytes(self.held[:n])
        del self.held[:n]
        return out


def parse(packed: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, payload) of each record of a gzip archive, one record in memory at a time; the payload is what follows the HTTP header block."""
    data = _Inflated(packed)
    while (block := data.upto(b"\r\n\r\n")) is not None:
        first, *lines = block.decode().split("\r\n")
        if first != "WARC/1.1":
            raise ValueError(f"no record starts with {first[:40]!r}")
        head = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
        body = data.take(int(head["Content-Length"]))
        yield head, body[body.index(b"\r\n\r\n") + 4 :]
        if data.take(4) != b"\r\n\r\n":
            raise ValueError(f"record {head.get('WARC-Record-ID')} does not end where it says")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, type, digest, size, refers_to, payload) of each record; digests are checked against the payloads."""

    def run(batches):
        import pyarrow as pa

        kinds = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("type", pa.string()), ("digest", pa.string()), ("size", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        for batch in batches:
            for content in batch.column("content"):
                rows, held = [], 0
                for head, payload in parse(content.as_py()):
                    name, refers = _id(head["WARC-Record-ID"]), head.get("WARC-Refers-To")
                    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    if refers is None and digest_of(payload) != digest:
                        raise ValueError(f"the payload of {name} does not match its digest")
                    rows.append((name, head["WARC-Target-URI"], head["WARC-Type"], digest, None if refers else len(payload), _id(refers) if refers else None, None if refers else payload))
                    held += len(payload)
                    if held > 1 << 23:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(run, "page_id long, url string, type string, digest string, size long, refers_to long, payload binary")


def _id(name: str) -> int | None:
    text = name.removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text else None


def deduplicate(spark: SparkSession, pages: DataFrame, path: str, least: int = 0, scratch: Scratch | None = None) -> DataFrame:
    """Writes the archives of pages to path and returns what they say when read again.

    Per row: page_id, payload_bytes, payload_digest, record_type, refers_to. A revisit's size is that of the response it refers
    to. Null html is an empty payload; a null page_id is never a response that others refer to; rows that repeat a page_id and
    its payload are records of their own, of one kind; an empty table writes no record; other columns play no part.
    """
    scratch = scratch or Scratch(spark, "warc")
    heads = scratch.keep(headers(pages), "heads")
    write_archives(pages, scratch.keep(resolve(heads, scratch, least), "resolved"), path)
    records = scratch.keep(read_archives(spark, path).drop("payload"), "records")
    originals = records.where("type = 'response'").select(F.col("page_id").alias("original"), F.col("digest").alias("d"), F.col("size").alias("full")).distinct()
    originals = scratch.keep(originals, "originals")
    return records.join(originals, (F.col("refers_to") == F.col("original")) & (F.col("digest") == F.col("d")), "left").select(
        "page_id", F.coalesce("size", "full").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to"
    )


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "warc")
    return deduplicate(spark, table(spark, sf_dir, "pages"), scratch.path("archives"), scratch=scratch)
