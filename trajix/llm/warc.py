"""WARC archives: a writer that stores equal payloads once, and a reader that salvages damaged files.

The writer makes one gzip member per record. Spark's text sink writes them: the separator that it
puts behind each row is the zero byte in which the members end, or the line feed in which plain
records end, so the files are ordinary archives, committed task by task wherever Spark can write.

The reader takes a file's records one after another. Where a member or a record fails its checks it
searches for the next member or version line that reads as a record, goes on there, and logs the
bytes between as a quarantined gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajix.llm.scratch import written

VERSION = b"WARC/1.1"
GZIP = b"\x1f\x8b\x08"
VERSION_LINE = re.compile(rb"WARC/\d\.\d\r\n")
PIECE = 1 << 13
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A gzip member ends with its size modulo 2^32, little endian: below this many bytes the last byte is zero.
MEMBER_BYTES = 1 << 24
#: Digests that are checked.
ALGORITHMS = ("md5", "sha1", "sha256", "sha384", "sha512")
#: Headers that every record has, and has once.
ONCE = ("warc-type", "warc-record-id", "warc-date", "content-length")
FIELDS = (
    "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, "
    "payload binary, path string, begin bigint, end bigint, reason string"
)


@dataclass
class Found:
    """A record, or with a reason a gap, at bytes begin to end of its file."""

    begin: int
    end: int
    headers: dict[str, str] = field(default_factory=dict)
    block: bytes = b""
    reason: str | None = None


def build_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, compress: bool) -> bytes:
    """One record up to, not with, the separator byte that the sink adds; a revisit has HTTP headers but no payload."""
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{page_id}"
    revisit = refers_to is not None
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + (b"" if revisit else payload)
    lines = [
        VERSION.decode(),
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        *([f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"] if revisit else []),
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    raw = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    if not compress:
        return raw[:-1]
    members = []
    for at in range(0, len(raw), MEMBER_BYTES - 1):  # more than one for very large records alone
        packer = zlib.compressobj(4, zlib.DEFLATED, 31)
        members.append(packer.compress(raw[at : at + MEMBER_BYTES - 1]) + packer.flush())
    return b"".join(members)[:-1]


def _differs(stated: str, content: bytes) -> bool:
    """Whether a stated digest, in hex or base32, is not that of the content; one of another algorithm is not checked."""
    name, _, value = stated.rpartition(":")
    name = name.strip().lower().replace("-", "") or ("sha256" if re.fullmatch(r"[0-9a-fA-F]{64}", value) else "")
    if name not in ALGORITHMS:
        return False
    own, value = hashlib.new(name, content).digest(), value.strip()
    return value.lower() != own.hex() and value.upper().rstrip("=") != base64.b32encode(own).decode().rstrip("=")


def _parse(raw: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int] | str:
    """Headers, block and end of the record at ``at``, or why there is none."""
    line = VERSION_LINE.match(raw, at)
    if not line:
        return "no version line"
    stop = raw.find(b"\r\n\r\n", line.end())
    if stop < 0:
        return "headers cut short"
    headers, last = {}, ""
    for row in raw[line.end() : stop].decode("utf-8", "replace").split("\r\n"):
        name, colon, value = row.partition(":")
        name = name.strip().lower()
        if last and row[:1] in (" ", "\t"):  # a folded header goes on
            headers[last] += " " + row.strip()
        elif not colon or name in ONCE and name in headers:  # another record's headers follow a cut
            return "headers cut short"
        else:
            headers[name], last = value.strip(), name
    size = headers.get("content-length", "")
    if not size.isascii() or not size.isdigit():
        return "no content length"
    end = stop + 4 + int(size)
    if raw[end : end + 4] != b"\r\n\r\n":
        return "block cut short or of another length"
    block = raw[stop + 4 : end]
    if _differs(headers.get("warc-block-digest", ""), block):
        return "block digest differs"
    return headers, block, end + 4


def _member(raw: bytes, at: int) -> tuple[bytes, int] | str:
    """What the gzip member at ``at`` holds and its end, or why it can't be read; zlib checks crc and size."""
    reader, view, parts = zlib.decompressobj(31), memoryview(raw), []
    try:
        while not reader.eof:
            if at >= len(raw):
                return "member cut short"
            parts.append(reader.decompress(view[at : at + PIECE]))
            at += PIECE
    except zlib.error as e:
        return f"member: {e}"
    return b"".join(parts), min(at, len(raw)) - len(reader.unused_data)


def _plain(data: bytes) -> Iterator[Found]:
    """The records of a member that holds several, and the gaps between them, at bytes of what the member holds."""
    at, gap, why = 0, None, ""
    while at < len(data):
        parsed = _parse(data, at)
        if isinstance(parsed, str):
            gap, why = (at, parsed) if gap is None else (gap, why)
            line = VERSION_LINE.search(data, at + 1)
            at = line.start() if line else len(data)
        else:
            if gap is not None:
                yield Found(gap, at, reason=why)
                gap = None
            yield Found(at, parsed[2], parsed[0], parsed[1])
            at = parsed[2]
    if gap is not None:
        yield Found(gap, len(data), reason=why)


def _zipped(raw: bytes, at: int) -> tuple[list[Found], int] | str:
    """The records and gaps of a member; members that don't begin with a version line go on with the one before.

    All of them lie at the member's bytes of the file; a gap's reason has its bytes within the member.
    """
    got = _member(raw, at)
    if isinstance(got, str):
        return got
    first, stop = data, end = got
    if VERSION_LINE.match(data):
        parsed = _parse(data)
        while isinstance(parsed, str) and len(data) % (MEMBER_BYTES - 1) == 0 and raw.startswith(GZIP, end):
            got = _member(raw, end)
            if isinstance(got, str) or VERSION_LINE.match(got[0]):
                break
            data, end = data + got[0], got[1]
            parsed = _parse(data)
        if isinstance(parsed, str):  # what follows is not the rest of this record
            data, end = first, stop
    found = list(_plain(data))
    if all(x.reason for x in found):
        return found[0].reason if found else "no version line"
    for x in found:
        x.reason = x.reason and f"{x.reason}, at bytes {x.begin} to {x.end} within the member"
        x.begin, x.end = at, end
    return found, end


def _next_start(raw: bytes, at: int) -> int:
    """The first byte from ``at`` on where a member or a version line might begin."""
    zipped, plain = raw.find(GZIP, at), VERSION_LINE.search(raw, at)
    return min([x for x in (zipped, plain.start() if plain else -1) if x >= 0], default=len(raw))


def salvage(raw: bytes) -> Iterator[Found]:
    """All records of a file in order and, as Found with a reason, the gaps between them."""
    at, gap, why = 0, None, ""
    while at < len(raw):
        if raw.startswith(GZIP, at):
            got = _zipped(raw, at)
        else:
            parsed = _parse(raw, at)
            got = parsed if isinstance(parsed, str) else ([Found(at, parsed[2], parsed[0], parsed[1])], parsed[2])
        if isinstance(got, str):
            gap, why = (at, got) if gap is None else (gap, why)
            at = _next_start(raw, at + 1)
        else:
            if gap is not None:
                yield Found(gap, at, reason=why)
                gap = None
            yield from got[0]
            at = got[1]
    if gap is not None:
        yield Found(gap, len(raw), reason=why)


def _page(value: str) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", value or "")
    return int(found[1]) if found else None


#: Revisits that are sent to every task that writes records, so that payloads stay where they are: about 150 bytes each.
MOST_SENT_REVISITS = 500_000


def _payloads(pages: DataFrame) -> DataFrame:
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload")
    )
    return rows.withColumn("payload_digest", F.sha2("payload", 256))


def revisits(pages: DataFrame, min_bytes: int = 100) -> DataFrame:
    """page_id, payload_digest and refers_to of the pages whose payload, of ``min_bytes`` or more, a smaller page_id has too.

    Ids and digests alone move; digests combine before they do, and meet their heads in a join
    whose hot digests Spark can split, as both sides are tables of their own.
    """
    slim = _payloads(pages).where((F.octet_length("payload") >= min_bytes) & F.col("page_id").isNotNull()).select("page_id", F.unhex("payload_digest").alias("digest"))
    slim = written(slim, "page-digests")
    heads = slim.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).where("refers_to < last").drop("last")
    joined = slim.join(written(heads, "page-heads"), "digest").where("page_id != refers_to")
    return joined.select("page_id", F.lower(F.hex("digest")).alias("payload_digest"), "refers_to").distinct()


def with_heads(pages: DataFrame, min_bytes: int = 100) -> DataFrame:
    """page_id, url, payload, payload_digest and refers_to, the smallest page_id with an equal payload of ``min_bytes`` or more."""
    found = written(revisits(pages, min_bytes), "page-revisits")
    if found.limit(MOST_SENT_REVISITS + 1).count() <= MOST_SENT_REVISITS:
        found = F.broadcast(found)
    return _payloads(pages).join(found, ["page_id", "payload_digest"], "left").select("page_id", "url", "payload", "payload_digest", "refers_to")


def write_warc(pages: DataFrame, path: str, min_bytes: int = 100, compress: bool = True) -> None:
    """Write a record per row of ``pages`` (page_id, url, html) to new archives under ``path``.

    Of pages with equal payloads of at least ``min_bytes``, the smallest page_id is a response and
    the others are revisits of it. A null html is an empty payload, a null url a urn of the page.
    Rows with a null page_id are responses. Repeated rows with the smallest page_id are responses
    each. An empty table gives archives without records; other columns are not looked at.

    Records are made where the pages lie. Spark then balances their bytes, so that an archive has
    about spark.sql.adaptive.advisoryPartitionSizeInBytes, however many records there are.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for page, url, payload, digest, head in zip(*(batch[c] for c in ("page_id", "url", "payload", "payload_digest", "refers_to"))):
                raw = build_record(page.as_py(), url.as_py(), payload.as_py(), digest.as_py(), head.as_py(), compress)
                yield pa.RecordBatch.from_arrays([pa.array([page.as_py()], pa.int64()), pa.array([raw], pa.binary())], names=["page_id", "value"])

    made = with_heads(pages, min_bytes).mapInArrow(build, "page_id bigint, value binary").hint("rebalance", "page_id")
    made.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\x00" if compress else "\n").option("maxRecordsPerFile", 0).text(path)


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Records and quarantined gaps of the archives under ``path``, one row each.

    A record's row has page_id, url, record_type, refers_to, payload_bytes and payload_digest (of
    the full payload, which a revisit states but does not hold), payload (null for revisits or
    without ``with_payload``), path, begin and end. A digest keeps the name of its algorithm unless
    that is sha256; digests of algorithms that are not in ``ALGORITHMS`` are not checked. A gap's row has path, begin, end and reason, and
    nulls. Records and gaps of a gzip member that holds several have the member's begin and end. A
    task holds one archive at a time; Spark refuses files above
    spark.sql.sources.binaryFile.maxLength (2 GiB), which are to be split first.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
             ("payload", pa.binary()), ("path", pa.string()), ("begin", pa.int64()), ("end", pa.int64()), ("reason", pa.string())]
        )
        for batch in batches:
            for name, content in zip(batch["path"].to_pylist(), batch["content"]):
                held, size = [], 0
                for x in salvage(content.as_py()):
                    row = {"path": name, "begin": x.begin, "end": x.end, "reason": x.reason}
                    if x.reason is None:
                        h = x.headers
                        http, _, payload = x.block.partition(b"\r\n\r\n")
                        kind, stated_digest = h.get("warc-type"), h.get("warc-payload-digest", "")
                        digest = stated_digest.removeprefix("sha256:") or None
                        if kind != "revisit" and not h.get("content-type", "application/http").lower().startswith("application/http"):
                            payload = x.block
                        n = len(payload)
                        if kind == "revisit":
                            stated = re.search(rb"(?i)\r\ncontent-length: *(\d+)", http)
                            n, payload = int(stated[1]) if stated else None, None
                        elif _differs(stated_digest, payload):
                            row["reason"] = "payload digest differs"
                        row |= {"page_id": _page(h.get("warc-record-id")), "url": h.get("warc-target-uri"), "record_type": kind, "refers_to": _page(h.get("warc-refers-to")),
                                "payload_bytes": n, "payload_digest": digest, "payload": payload if with_payload else None}
                    held.append(row)
                    size += len(x.block)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held, size = [], 0
                yield pa.RecordBatch.from_pylist(held, schema)

    files = spark.read.format("binaryFile").load(path).where("length > 0").select("path", "content")
    return files.mapInArrow(rows, FIELDS)
