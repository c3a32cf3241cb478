"""Operator 9."""

import base64
import gzip
import hashlib
from collections import Counter, defaultdict
from pathlib import Path

import pytest

from lodestream.llm import warc
from lodestream.llm.common import shared_dir
from tests.llm import helpers
from tests.oracle import assert_same

BIG = "x" * 700_000
PAGES = [
    (1, "http://a", BIG), (2, "http://b\r\nX: y", BIG), (3, None, None), (4, "u", ""),
    (5, "u", "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" * 40), (6, "u", "\n" * 3000), (7, "u", "\n" * 3000),
    (8, "u", "a\r"), (9, "é", "é\n" * 300_000), (10, "u", "é" * 600), (11, "u", "é" * 600), (12, "u", "s"), (13, "u", "s"),
    (14, "u", "\r"), (15, "u", "\n"), (16, "u", "y" * 999), (17, "u", "y" * 999), (18, "u", "z" * 1000), (19, "u", "z" * 1000),
    (None, "n", BIG), (None, None, "w" * 2000), (20, "u", "t" * 1500), (20, "u", "t" * 1500),
]


def expected(pages):
    most = defaultdict(list)
    for i, _, h in pages:
        most[h or ""].append(i)
    out = Counter()
    for i, _, h in pages:
        data = (h or "").encode()
        top = max((x for x in most[h or ""] if x is not None), default=None)
        to = top if len(data) >= 1000 and top is not None and i != top else None
        out[i, len(data), hashlib.sha1(data).hexdigest(), "response" if to is None else "revisit", to] += 1
    return out


def test_round_trip(spark):
    path = shared_dir(spark)
    pages = spark.createDataFrame(PAGES, helpers.PAGES)
    warc.write_warc(warc.planned(pages), path)
    chunks = warc.read_warc(spark, path)
    assert Counter(tuple(r) for r in warc.records(chunks).collect()) == expected(PAGES)
    payloads, sizes = defaultdict(bytes), []
    rows = chunks.collect()
    assert {r["record_id"] is None for r in rows} == {False}
    for r in sorted(rows, key=lambda r: (str(r["page_id"]), r["chunk"])):
        payloads[r["page_id"]] += r["payload"]
        sizes.append(len(r["payload"]))
        if r["page_id"] not in (None, 20):
            assert r["bytes_so_far"] == len(payloads[r["page_id"]])
            assert r["sha1_so_far"] == hashlib.sha1(payloads[r["page_id"]]).hexdigest()
    assert payloads[9] == ("é\n" * 300_000).encode() and payloads[2] == BIG.encode() and payloads[1] == b"" and payloads[14] == b"\r"
    assert max(sizes) <= warc.CHUNK
    ids = Counter(r["record_id"] for r in rows if r["last"])
    assert [n for n in ids.values() if n > 1] == [2]  # the page that stands twice
    for file in Path(path).glob("*.gz"):
        data = gzip.decompress(file.read_bytes())
        assert not data or data.startswith(b"WARC/1.1\r\n") and data.endswith(b"\r\n\r\n")


def test_damage_is_noticed(spark):
    path = shared_dir(spark)
    warc.write_warc(warc.planned(spark.createDataFrame(PAGES[:1], helpers.PAGES)), path)
    for file in Path(path).glob("*.gz"):
        data = gzip.decompress(file.read_bytes())
        file.write_bytes(gzip.compress(data.replace(b"xxxxx", b"xxxyx", 1)))
        for crc in Path(path).glob(".*.crc"):
            crc.unlink()
    with pytest.raises(Exception, match="damaged WARC record of page 1"):
        warc.records(warc.read_warc(spark, path)).collect()


def test_no_row_has_a_payload_without_line_feeds(spark):
    size = 20_000_003
    path = shared_dir(spark)
    pages = spark.range(1).selectExpr("1L AS page_id", "'u' AS url", f"repeat('é', {size}) AS html", "2L AS payload_bytes")
    warc.write_warc(warc.planned(pages), path)
    lines = spark.read.option("lineSep", "\n").text(path)
    assert lines.selectExpr("max(octet_length(value))").first()[0] <= warc.CHUNK + 1
    chunks = warc.read_warc(spark, path)
    assert chunks.selectExpr("max(octet_length(payload))").first()[0] <= warc.CHUNK
    (r,) = warc.records(chunks).collect()
    assert tuple(r) == (1, 2 * size, hashlib.sha1(("é" * size).encode()).hexdigest(), "response", None)


def test_archives_of_other_writers(spark, tmp_path):
    body = b"line\r\nand more\n" * 10
    http = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n"
    coded = b"HTTP/1.1 200 OK\r\ntransfer-encoding: chunked\r\n\r\n" + b"a;x=y\r\n" + body[:10] + b"\r\n%x\r\n" % len(body[10:]) + body[10:] + b"\r\n0\r\nT: z\r\n\r\n"
    blocks = {"warcinfo": ("application/warc-fields", b"software: x\r\n"), "resource": ("text/plain", body), "response": ("application/http; msgtype=response", http + body), "request": ("application/http", coded), "metadata": ("text/plain", b"")}
    data = b""
    for kind, (mime, block) in blocks.items():
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        data += f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:{kind}>\r\nWARC-Payload-Digest: sha1:{digest}\r\nContent-Type: {mime}\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(x) for x in (data[:200], data[200:])))
    rows = {r["record_type"]: r for r in warc.read_warc(spark, str(tmp_path)).collect()}
    assert set(rows) == set(blocks) and all(r["page_id"] is None and r["last"] for r in rows.values())
    assert all(bytes(rows[k]["payload"]) == body for k in ("resource", "response", "request"))
    assert rows["response"]["declared_sha1"] == hashlib.sha1(body).hexdigest() == rows["response"]["sha1_so_far"]


def foreign(path, payloads, cut=7001):
    """Archives of several gzip members, and one that isn't compressed."""
    data = b""
    for n, (mime, block) in enumerate(payloads):
        data += f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:{n}>\r\nContent-Type: {mime}\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    (path / "a.warc.gz").write_bytes(b"".join(gzip.compress(data[i : i + cut]) for i in range(0, len(data), cut)))
    (path / "b.warc").write_bytes(data)


def test_streams_give_what_lines_give(spark, tmp_path):
    body = (b"no line feed " * 60_000, b"", b"a\n" * 300_000, b"\n", b"x", bytes(range(256)) * 5000)
    coded = b"HTTP/1.1 200 OK\r\ntransfer-encoding: chunked\r\n\r\n" + b"".join(b"%x\r\n%b\r\n" % (len(b), b) for b in body if b) + b"0\r\nT: z\r\n\r\n"
    plain = [("text/plain", b) for b in body] + [("application/http", b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n" + b) for b in body]
    foreign(tmp_path, [*plain, ("application/http", coded), ("application/http", b"HTTP/1.1 204 No\r\nA: b")])
    read = lambda name, way: sorted(map(str, warc.read_warc(spark, str(tmp_path / name), way).collect()))
    assert read("a.warc.gz", True) == read("b.warc", True) == read("a.warc.gz", False) and len(read("b.warc", True)) > 30
    last = {r["record_id"]: r for r in warc.read_warc(spark, str(tmp_path), True).where("last").collect()}
    assert [last[f"<urn:uuid:{n}>"]["sha1_so_far"] for n in range(12)] == [hashlib.sha1(b).hexdigest() for b in body * 2]
    assert last["<urn:uuid:12>"]["bytes_so_far"] == sum(map(len, body))


def test_own_archives_streamed(spark):
    path = shared_dir(spark)
    warc.write_warc(warc.planned(spark.createDataFrame(PAGES, helpers.PAGES)), path)
    one, two = (sorted(map(str, warc.records(warc.read_warc(spark, path, way)).collect())) for way in (True, False))
    assert one == two and len(one) == len(PAGES)


def test_columns_of_other_names(spark):
    rows = [(1, "u", "a" * 2000, "x", "y"), (2, "u", "a" * 2000, "x", "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, record_type string, `we.ird` string")
    got = {(r["page_id"], r["record_type"], r["refers_to"]) for r in warc.planned(pages).collect()}
    assert got == {(2, "response", None), (1, "revisit", 2)}


def test_empty(spark):
    path = shared_dir(spark)
    warc.write_warc(warc.planned(helpers.empty(spark, helpers.PAGES)), path)
    assert warc.read_warc(spark, path).count() == 0


def test_op9_is_its_sql(spark, data):
    assert_same(warc.op9_warc(spark, data), data, warc.ORACLE)
