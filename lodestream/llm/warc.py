"""WARC archives, written and read as a stream of lines and a table of chunks.

An archive is one gzip file of WARC/1.1 records that Spark's own text writer puts into shared storage, so it may be in
any store that Spark reaches. The block of a response is an HTTP message with chunked transfer coding, in which a line
break follows each chunk: so no line is much longer than a chunk, whatever the payload holds, and Spark's text reader
never has a whole payload in a row. Payloads come back as rows of record and chunk number that carry the digest so far,
and no task joins a payload together.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.llm.common import bound_batches, brought_back, shared_dir, table, texts_of, written

#: Payload bytes of a chunk at most, in an archive and in the table of chunks.
CHUNK = 256 << 10
#: Payloads from this size on are written once, and revisited by their copies.
REVISIT_FROM = 1000

_DATE = "1970-01-01T00:00:00Z"
CHUNKS = "record_id string, page_id bigint, url string, record_type string, refers_to bigint, declared_bytes bigint, declared_sha1 string, chunk int, payload binary, bytes_so_far bigint, sha1_so_far string, last boolean"


def planned(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) with payload_bytes, payload_digest, record_type and refers_to.

    Of equal payloads of REVISIT_FROM bytes or more the one with the largest page_id is the response, the others
    revisit it. Null html counts as empty. A null page_id is never the largest; if all are null, all are responses, as
    are repeated rows of the largest. Only digests are grouped, combined before the shuffle, and only those of groups
    come back to the pages.
    """
    html = F.coalesce("html", F.lit(""))
    pages = pages.select("page_id", "url", html.alias("html"), F.octet_length(html).cast("bigint").alias("payload_bytes"), F.sha1(html.cast("binary")).alias("payload_digest"))
    groups = pages.where(F.col("payload_bytes") >= REVISIT_FROM).groupBy(F.col("payload_digest").alias("_of")).agg(F.max("page_id").alias("_to"), F.count("*").alias("_n"))
    groups = written(groups.where("_n > 1").drop("_n"), pages.sparkSession)
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("_to")), F.col("_to"))
    joined = brought_back(pages, groups, "payload_digest", "_of").withColumn("refers_to", refers).drop("_of", "_to")
    return joined.withColumn("record_type", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit"))


def _urn(page_id: int | None, digest: str) -> str:
    """The id of a page's record; only rows that repeat both page and payload share one."""
    return f"<urn:page:{'' if page_id is None else page_id}:{digest}>"


def _escaped(url: str) -> str:
    """A url as one header line: what would end the line is percent-encoded."""
    return url.replace("\r", "%0D").replace("\n", "%0A")


_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r"


def _cuts(data: memoryview) -> list[int]:
    """Where chunks of a UTF-8 text end: each has CHUNK bytes at most and no part of a code point."""
    ends, at = [], 0
    while at < len(data):
        end = min(len(data), at + CHUNK)
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end -= 1
        ends.append(end)
        at = end
    return ends


def _lines(row: dict, data: memoryview) -> Iterator[str]:
    """What, with a line feed behind each piece, makes up the record of a page."""
    response = row["record_type"] == "response"
    ends = _cuts(data) if response else []
    sizes = [f"{b - a:x}" for a, b in zip([0, *ends], ends, strict=False)]
    length = len(_HTTP) + 1 + len(data) + sum(map(len, sizes)) + 4 * len(sizes) + 5 if response else 0
    yield f"WARC/1.1\r\nWARC-Type: {row['record_type']}\r\nWARC-Record-ID: {_urn(row['page_id'], row['payload_digest'])}\r\nWARC-Date: {_DATE}\r"
    if row["url"] is not None:
        yield f"WARC-Target-URI: {_escaped(row['url'])}\r"
    if not response:
        yield "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r"
        yield f"WARC-Refers-To: {_urn(row['refers_to'], row['payload_digest'])}\r"
    yield f"WARC-Payload-Digest: sha1:{row['payload_digest']}\r\nX-Payload-Length: {row['payload_bytes']}\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: {length}\r\n\r"
    if response:
        yield _HTTP
        for size, a, b in zip(sizes, [0, *ends], ends, strict=False):
            yield f"{size}\r\n{bytes(data[a:b]).decode()}\r"
        yield "0\r\n\r"
    yield "\r\n\r"


def _records(batches) -> Iterator[pa.RecordBatch]:
    """Text rows that, each with a line feed behind it, make up WARC records."""
    for batch in batches:
        rows = batch.select(["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]).to_pylist()
        out, size = [], 0
        for row, html in zip(rows, texts_of(batch.column("html")), strict=True):
            for line in _lines(row, memoryview(html.as_buffer())):
                out.append(line)
                size += len(line)
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])
                    out, size = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])


def write_warc(planned_pages: DataFrame, path: str) -> None:
    """One archive per partition, in the folder path."""
    bound_batches(planned_pages.sparkSession)
    planned_pages.mapInArrow(_records, "value string").write.option("lineSep", "\n").option("compression", "gzip").text(path)


class _Reader:
    """Reads the lines of one archive in turn; what it has of a payload is a chunk and a line at most, and a digest.

    The payload of a record is its block; that of an HTTP message is its body, without a chunked transfer coding.
    """

    def __init__(self):
        self.head, self.left, self.rows, self.tail = None, -1, [], b""

    def feed(self, line: bytes) -> None:
        """line: without its line feed."""
        if self.left >= 0:
            self.block(line + b"\n")
        elif self.head is None:
            if line.startswith(b"WARC/1."):
                self.head = {}
            elif line.strip(b"\r"):
                raise ValueError(f"no WARC record starts with {line[:80]!r}")
        elif line.strip(b"\r"):
            name, _, value = line.rstrip(b"\r").decode("utf-8", "replace").partition(":")
            self.head[name.lower()] = value.strip()
        else:
            self.begin()

    def stream(self, data: bytes) -> None:
        """Some bytes of the archive, wherever they are cut: payloads are taken as they come, other lines whole."""
        data = self.tail + data
        view, at = memoryview(data), 0
        while at < len(data):
            if self.left >= 0 and self.mode in ("all", "data", "break"):
                end = at + min(self.left, len(data) - at, self.left if self.mode == "all" else self.need)
                self.block(view[at:end])
            else:
                feed = data.find(b"\n", at)
                end = len(data) if feed < 0 else feed + 1
                if 0 <= self.left <= end - at:  # what is left of the block ends without a line feed
                    end = at + self.left
                elif feed < 0:
                    if end - at > CHUNK:
                        raise ValueError(f"a header line of more than {CHUNK} bytes")
                    break
                self.feed(data[at : end - (self.left < 0)]) if self.left < 0 else self.block(view[at:end])
            at = end
        self.tail = data[at:]

    def begin(self) -> None:
        self.left = int(self.head["content-length"])
        self.size, self.chunk, self.digest, self.buffer = 0, 0, hashlib.sha1(), bytearray()
        self.mode = "http" if self.head.get("content-type", "").startswith("application/http") else "all"
        self.coded, self.need = False, 0
        if not self.left:
            self.emit(True)

    def block(self, line: bytes | memoryview) -> None:
        """A line of the block, or as much of it as belongs to the block."""
        data = memoryview(line)[: self.left]
        self.left -= len(data)
        while len(data):
            if self.mode == "all":
                self.take(data)
                break
            if self.mode == "data":
                self.take(data[: self.need])
                data, self.need = data[self.need :], self.need - min(self.need, len(data))
                if not self.need:
                    self.mode, self.need = "break", 2
            elif self.mode == "break":  # the line break behind a chunk
                data, self.need = data[self.need :], self.need - min(self.need, len(data))
                if not self.need:
                    self.mode = "size"
            else:
                self.line(bytes(data))
                break
        if not self.left:
            self.emit(True)

    def line(self, line: bytes) -> None:
        """A line of the HTTP message that isn't of its body."""
        if self.mode == "http":
            if not line.strip(b"\r\n"):
                self.mode = "size" if self.coded else "all"
            elif line.lower().startswith(b"transfer-encoding:"):
                self.coded = b"chunked" in line.lower()
        elif self.mode == "size":
            self.need = int(line.partition(b";")[0], 16)
            self.mode = "data" if self.need else "trailer"

    def take(self, data: memoryview) -> None:
        """Some of the payload. A chunk is emitted once it is known that more follows."""
        for at in range(0, len(data), CHUNK):
            self.buffer += data[at : at + CHUNK]
            if len(self.buffer) > CHUNK:
                self.emit(False)

    def emit(self, last: bool) -> None:
        data, self.buffer = bytes(self.buffer[:CHUNK]), self.buffer[CHUNK:]
        self.digest.update(data)
        self.size += len(data)
        h = self.head
        known = h.get("x-payload-length")
        self.rows.append((h.get("warc-record-id"), _page(h.get("warc-record-id")), h.get("warc-target-uri"), h.get("warc-type"), _page(h.get("warc-refers-to")), known and int(known), _sha1(h.get("warc-payload-digest")), self.chunk, data, self.size, self.digest.hexdigest(), last))
        self.chunk += 1
        if last:
            self.head, self.left = None, -1


def _page(urn: str | None) -> int | None:
    """The page of a record's id; null for ids of other makers."""
    found = re.fullmatch(r"<urn:page:(-?\d+):.*>", urn or "")
    return int(found[1]) if found else None


def _sha1(digest: str | None) -> str | None:
    """A SHA-1 in hexadecimal digits; archives also have it in base 32. Other digests are null."""
    kind, _, value = (digest or "").partition(":")
    if kind.lower() != "sha1":
        return None
    return base64.b32decode(value).hex() if re.fullmatch("[A-Z2-7]{32}", value) else value.lower()


_NAMES = [x.split()[0] for x in CHUNKS.split(", ")]
_KINDS = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.int64(), pa.string(), pa.bool_()]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], names=_NAMES)


def _chunks(batches) -> Iterator[pa.RecordBatch]:
    reader, file = _Reader(), None
    for batch in batches:
        for name, line in zip(batch.column("file").to_pylist(), batch.column("value"), strict=True):
            if name != file:
                if reader.head is not None:
                    raise ValueError(f"{file} ends within a record")
                file = name
            reader.feed(line.as_py())
        if reader.rows:
            yield _batch(reader.rows)
            reader.rows = []
    if reader.head is not None:
        raise ValueError(f"{file} ends within a record")


def _inflated(source) -> Iterator[bytes]:
    """The contents of an open file, CHUNK bytes at a time; of gzip files, which may have many members, inflated."""
    data = source.read(CHUNK)
    if data[:2] != b"\x1f\x8b":
        while data:
            yield data
            data = source.read(CHUNK)
        return
    member = zlib.decompressobj(31)
    while data:
        yield member.decompress(data, CHUNK)
        if member.eof:
            data, member = member.unused_data, zlib.decompressobj(31)
        else:
            data = member.unconsumed_tail
        data = data or source.read(CHUNK)


def _streamed(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for uri in batch.column("path").to_pylist():
            store, name = FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))
            reader = _Reader()
            with store.open_input_stream(name, compression=None) as source:
                for data in _inflated(source):
                    reader.stream(data)
                    if len(reader.rows) >= 16:
                        yield _batch(reader.rows)
                        reader.rows = []
            if reader.head is not None:
                raise ValueError(f"{uri} ends within a record")
            if reader.rows:
                yield _batch(reader.rows)


def read_warc(spark: SparkSession, path: str, streamed: bool = False) -> DataFrame:
    """The chunk table of the archives in a folder: a row for each chunk of a record, with the bytes and the SHA-1 so far.

    Records of any type have rows; page_id, refers_to and declared_bytes are null for records of other writers. gzip
    files aren't split, so that each is read from its start by one task; their number and size are the writer's.

    Spark's text reader brings the lines, from any store that it reaches; of archives that write_warc() has written none
    is much longer than CHUNK. Archives of other writers may have payloads without a line feed, each of which is a row, and
    uncompressed ones may be split within a record, which is an error. For those,
    with ``streamed`` the tasks open the files themselves, through pyarrow (local and mounted folders, S3, GCS, Azure,
    HDFS), and hold some chunks at a time, whatever the payload.
    """
    bound_batches(spark)
    if streamed:
        return spark.read.format("binaryFile").load(path).select("path").mapInArrow(_streamed, CHUNKS)
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value"))
    return lines.mapInArrow(_chunks, CHUNKS)


def records(chunks: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each record, from its last chunk.

    Of a response they are counted from what was read, and must be what its headers say; of a revisit they are those
    of the payload that it stands for.
    """
    whole = F.col("record_type") == "response"
    wrong = whole & ((F.col("bytes_so_far") != F.col("declared_bytes")) | (F.col("sha1_so_far") != F.col("declared_sha1")))
    checked = F.when(wrong, F.raise_error(F.concat(F.lit("damaged WARC record of page "), F.col("page_id").cast("string"))))
    digest = F.coalesce(checked.cast("string"), F.when(whole, F.col("sha1_so_far")).otherwise(F.col("declared_sha1")))
    size = F.when(whole, F.col("bytes_so_far")).otherwise(F.col("declared_bytes"))
    return chunks.where("last").select("page_id", size.alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    write_warc(planned(table(spark, sf_dir, "pages").select("page_id", "url", "html")), path)
    return records(read_warc(spark, path))


ORACLE = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), m AS (
  SELECT *, max(page_id) OVER (PARTITION BY html) AS top FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to
FROM m
"""
