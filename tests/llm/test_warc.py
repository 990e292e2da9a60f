"""WARC archives written, read back, damaged and salvaged."""

import base64
import gzip
import hashlib

import pytest

from trajix.llm import warc
from trajix.llm.scratch import new_path

PAGES = "page_id bigint, url string, html string, digest string"


def record(page, payload, compress=True, head=None):
    return warc.build_record(page, "http://x/", payload, hashlib.sha256(payload).hexdigest(), head, compress) + (b"\0" if compress else b"\n")


@pytest.fixture(scope="module")
def pages(spark):
    big = "é" * 80
    rows = [(5, "http://a b/", big), (3, None, big), (9, "u", big), (1, "u", "short"), (2, "u", "short"), (4, "u", None), (None, "u", big), (7, "u", ""), (8, "u\nv", "x" * 100), (8, "u", "x" * 100)]
    return spark.createDataFrame([(*r, "clash") for r in rows], PAGES)


@pytest.mark.parametrize("compress", [True, False])
def test_round_trip(spark, pages, compress):
    path = new_path(spark, "test-warc")
    warc.write_warc(pages, path, compress=compress)
    rows = warc.read_warc(spark, path).collect()
    assert all(r["reason"] is None for r in rows) and len(rows) == pages.count()
    for r in rows:
        assert r["refers_to"] == (3 if r["page_id"] in (5, 9) else None)
        assert r["record_type"] == ("revisit" if r["page_id"] in (5, 9) else "response")
        if r["payload"] is not None:
            assert hashlib.sha256(r["payload"]).hexdigest() == r["payload_digest"] and len(r["payload"]) == r["payload_bytes"]
        else:
            assert r["payload_bytes"] == 160
    empty = new_path(spark, "test-warc")
    warc.write_warc(pages.where("false"), empty)
    assert warc.read_warc(spark, empty).count() == 0


def test_members_are_gzip():
    raw = record(1, b"p" * 50) + record(2, b"q" * 50)
    assert gzip.decompress(raw).count(b"WARC/1.1") == 2


def test_large_records_span_members():
    payload = bytes(range(256)) * (1 << 17)
    raw = record(1, payload) + record(2, b"next")
    found = list(warc.salvage(raw))
    assert [f.reason for f in found] == [None, None] and found[0].block.endswith(payload) and found[1].end == len(raw)


@pytest.mark.parametrize("compress", [True, False])
def test_salvage(compress):
    parts = [record(i, f"payload {i} ".encode() * 30, compress) for i in range(6)]
    broken = bytearray(parts[2])
    broken[len(broken) // 2] ^= 0xFF
    cut = parts[4][: len(parts[4]) // 2]
    raw = b"junk" + parts[0] + parts[1] + bytes(broken) + parts[3] + cut + parts[5]
    found = list(warc.salvage(raw))
    kept = [f.headers["warc-record-id"] for f in found if f.reason is None]
    assert kept == [f"<urn:page:{i}>" for i in (0, 1, 3, 5)]
    gaps = [(f.begin, f.end) for f in found if f.reason]
    at = 4 + len(parts[0]) + len(parts[1])
    assert gaps == [(0, 4), (at, at + len(parts[2])), (at + len(parts[2]) + len(parts[3]), len(raw) - len(parts[5]))]
    assert [b for f in found for b in (f.begin, f.end)] == sorted(b for f in found for b in (f.begin, f.end))
    assert [(f.begin, f.end) for f in warc.salvage(b"nothing here")] == [(0, 12)] and list(warc.salvage(b"")) == []


def test_several_records_in_a_member():
    parts = [record(i, f"payload {i} ".encode() * 30, False) for i in range(4)]
    alone = record(9, b"alone")
    ids = lambda found: [f.headers["warc-record-id"] for f in found if f.reason is None]
    sound = gzip.compress(b"".join(parts))
    found = list(warc.salvage(sound + alone))
    assert ids(found) == [f"<urn:page:{i}>" for i in (0, 1, 2, 3, 9)] and not any(f.reason for f in found)
    assert {(f.begin, f.end) for f in found} == {(0, len(sound)), (len(sound), len(sound) + len(alone))}
    for k in range(4):
        bad = bytearray(parts[k])
        bad[-20] ^= 0xFF
        member = gzip.compress(b"".join([*parts[:k], bytes(bad), *parts[k + 1 :]]))
        found = list(warc.salvage(member + alone))
        assert ids(found) == [f"<urn:page:{i}>" for i in (0, 1, 2, 3, 9) if i != k]
        at = sum(map(len, parts[:k]))
        [gap] = [f for f in found if f.reason]
        assert (gap.begin, gap.end) == (0, len(member)) and f"bytes {at} to {at + len(bad)} within" in gap.reason
    found = list(warc.salvage(gzip.compress(b"junk" + parts[0] + b"rest")))
    assert [bool(f.reason) for f in found] == [True, False, True]


def crawl_record(page, payload, label, digest):
    """A record as crawlers write it, with the block and payload digests that ``digest`` gives."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + payload
    head = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{page}>\r\nWARC-Payload-Digest: {label}:{digest(payload)}\r\nWARC-Block-Digest: {label}:{digest(block)}\r\n"
    return f"{head}Content-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def test_digests_by_their_algorithm(spark, tmp_path):
    base32 = lambda name: lambda b: base64.b32encode(hashlib.new(name, b).digest()).decode()
    hexed = lambda name: lambda b: hashlib.new(name, b).hexdigest().upper()
    kinds = [("sha1", base32("sha1")), ("sha1", hexed("sha1")), ("sha256", base32("sha256")), ("SHA-256", hexed("sha256")), ("xxh3", lambda b: "0" * 16)]
    records = [crawl_record(i, b"<html>%d</html>" % i, *k) for i, k in enumerate(kinds)]
    (tmp_path / "sound.warc").write_bytes(b"".join(records))
    rows = warc.read_warc(spark, f"file://{tmp_path}").orderBy("begin").collect()
    assert [(r["page_id"], r["reason"]) for r in rows] == [(i, None) for i in range(len(kinds))]
    for i in range(4):
        broken = records[i].replace(b"<html>", b"<HTML>")
        assert [f.reason for f in warc.salvage(broken)] == ["block digest differs"]
        (tmp_path / f"{i}.warc").write_bytes(broken.replace(b"WARC-Block-Digest", b"X-Block-Digest"))
        [row] = warc.read_warc(spark, f"file://{tmp_path}/{i}.warc").collect()
        assert row["reason"] == "payload digest differs"


@pytest.mark.parametrize("compress", [True, False])
def test_cuts_at_every_byte(spark, tmp_path, compress):
    """A record that is cut at any byte is a gap up to the next one, which is kept with its own bytes."""
    first, second = record(1, b"first " * 9, compress), record(2, b"second " * 9, compress)
    for cut in range(1, len(first)):
        gap, found = warc.salvage(first[:cut] + second)
        assert (gap.begin, gap.end) == (0, cut) and gap.reason
        assert (found.begin, found.end) == (cut, cut + len(second)) and found.reason is None
        assert found.headers["warc-record-id"] == "<urn:page:2>"
    cuts = range(5, len(first), 37)
    for cut in cuts:
        (tmp_path / f"{cut}.warc").write_bytes(first[:cut] + second + first[:cut])
    rows = warc.read_warc(spark, f"file://{tmp_path}").collect()
    for cut in cuts:
        own = sorted((r["begin"], r["end"], r["page_id"], r["reason"] is None) for r in rows if r["path"].endswith(f"/{cut}.warc"))
        end = cut + len(second)
        assert own == [(0, cut, None, False), (cut, end, 2, True), (end, end + cut, None, False)]


def test_headers_as_others_write_them():
    block = b"text"
    head = lambda *more: b"\r\n".join([b"WARC/1.0", b"WARC-Type: resource", *more, b"WARC-Record-ID: <urn:page:4>", b"Content-Length: 4"]) + b"\r\n\r\n" + block + b"\r\n\r\n"
    for raw in (head(b"WARC-Target-URI: http://x/WARC/1.0"), head(b"X-Long: a", b"\tb", b" c"), head(b"WARC-Concurrent-To: <a>", b"WARC-Concurrent-To: <b>")):
        [found] = warc.salvage(raw)
        assert found.reason is None and found.block == block
    [found] = warc.salvage(head(b"X-Long: a", b"\tb"))
    assert found.headers["x-long"] == "a b"
    assert [f.reason for f in warc.salvage(head(b"no colon"))] == ["headers cut short"]


def test_equal_pages_stay_where_they_are(spark):
    """20,000 equal pages: payloads meet no shuffle by digest, and archives keep to the asked size."""
    pages = spark.range(24_000, numPartitions=6).selectExpr("id as page_id", "'u' as url", "if(id % 6 = 0, concat('own ', id, repeat('y', 200)), repeat('popular ', 40)) as html")
    rows = warc.with_heads(pages)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    got = {r["page_id"]: r["refers_to"] for r in rows.select("page_id", "refers_to").collect()}
    assert got == {i: None if i % 6 == 0 or i == 1 else 1 for i in range(24_000)}
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "400k")
    try:
        path = new_path(spark, "test-warc")
        warc.write_warc(pages, path)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    sizes = [r["length"] for r in spark.read.format("binaryFile").load(path).select("length").collect()]
    assert len(sizes) > 8 and max(sizes) < 3 * 400 * 1024
    assert warc.read_warc(spark, path, with_payload=False).where("reason is null").count() == 24_000
