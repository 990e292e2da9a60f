"""Binary files of token ids in bit or byte planes.

A file holds chunks and a footer. A chunk has a fixed number of ids (the last of a file may have
fewer, and empty records may follow it), transposed into planes: plane b has bit b (or byte b) of every id, and each plane is
compressed with zstandard on its own. The footer has the chunk index (byte offset, byte length,
first id, ids) and the documents (doc_id, first id, ids); the file's last bytes say where it begins.
Every chunk and the footer end with a line feed, so that Spark's text sink, whose line separator
this is, writes the files with its own commit protocol wherever Spark can write.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trajix.llm.bpe_ids import RunBpe, steps, tidy
from trajix.llm.scratch import new_path, written

CHUNK, FOOTER = b"TXPC", b"TXPF"
HEAD, TAIL = struct.Struct("<4sBBHI"), struct.Struct("<QI4s")
BIT, BYTE = 1, 8
DOCS = "part bigint, doc_id bigint, local_start bigint, n_tokens bigint, ids_crc32 bigint"


def encode_chunk(ids: np.ndarray, width: int = BIT, level: int = 3) -> bytes:
    """One chunk without its line feed: header, lengths of the planes, planes."""
    ids = ids.astype("<u4", copy=False)
    bits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    packer = zstandard.ZstdCompressor(level=level)
    if width == BIT:
        planes = [np.packbits((ids >> b & 1).astype(np.uint8)).tobytes() for b in range(bits)]
    else:
        planes = [np.ascontiguousarray(ids.view(np.uint8)[b::4]).tobytes() for b in range(-(-bits // 8))]
    packed = [packer.compress(p) for p in planes]
    return HEAD.pack(CHUNK, width, len(packed), 0, len(ids)) + struct.pack(f"<{len(packed)}I", *map(len, packed)) + b"".join(packed)


def decode_chunk(raw: bytes | memoryview) -> np.ndarray:
    """The ids of a chunk, as unsigned 32-bit integers."""
    magic, width, planes, _, n = HEAD.unpack_from(raw)
    if magic != CHUNK:
        raise ValueError("not a chunk of token planes")
    sizes = struct.unpack_from(f"<{planes}I", raw, HEAD.size)
    at, out, unpacker = HEAD.size + 4 * planes, np.zeros(n, "<u4"), zstandard.ZstdDecompressor()
    for b, size in enumerate(sizes):
        plane = np.frombuffer(unpacker.decompress(bytes(raw[at : at + size])), np.uint8)
        if width == BIT:
            out |= np.unpackbits(plane, count=n).astype("<u4") << np.uint32(b)
        else:
            out.view(np.uint8)[b::4] = plane
        at += size
    return out


class FileMaker:
    """Turns one task's documents, in order, into the records of its files.

    Each file has ``records`` records, so that a sink which begins a new file after as many divides them as
    here: chunks, empty records where a file ends early, and the footer. A file ends before the document
    that would not fit; a document larger than a file has one of its own, with larger chunks.
    """

    def __init__(self, task: int, chunk_ids: int, records: int, width: int, level: int):
        self.task, self.chunk_ids, self.records, self.width, self.level = task, chunk_ids, records, width, level
        self.files = 0
        self._begin()

    def _begin(self) -> None:
        self.waiting: list[np.ndarray] = []
        self.n_waiting = self.n = self.at = 0
        self.each = self.chunk_ids
        self.index: list[tuple[int, int, int, int]] = []
        self.docs: list[np.ndarray] = []

    def _chunk(self, ids: np.ndarray) -> bytes:
        raw = encode_chunk(ids, self.width, self.level)
        first = self.index[-1][2] + self.index[-1][3] if self.index else 0
        self.index.append((self.at, len(raw) + 1, first, len(ids)))
        self.at += len(raw) + 1
        return raw

    def _take(self, doc_ids: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> Iterator[bytes]:
        starts = self.n + np.cumsum(sizes) - sizes
        self.docs.append(np.stack([doc_ids.data, np.ma.getmaskarray(doc_ids).astype(np.int64), starts, sizes]))
        self.n += len(ids)
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= self.each:
            joined = np.concatenate(self.waiting)
            full = len(joined) // self.each * self.each
            for at in range(0, full, self.each):
                yield self._chunk(joined[at : at + self.each])
            self.waiting, self.n_waiting = [joined[full:]], len(joined) - full

    def add(self, doc_ids: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> Iterator[bytes]:
        """doc_ids: a masked array. Yields the records that are ready now."""
        most, ends, done = (self.records - 1) * self.chunk_ids, np.cumsum(sizes), 0
        while done < len(sizes):
            before = int(ends[done - 1]) if done else 0
            upto = int(np.searchsorted(ends, before + most - self.n, "right"))
            if upto <= done and self.n:
                yield from self.end_file()
                continue
            if upto <= done:
                upto = done + 1
                self.each = max(self.chunk_ids, -(-int(sizes[done]) // (self.records - 1)))
            yield from self._take(doc_ids[done:upto], ids[before : ends[upto - 1]], sizes[done:upto])
            done = upto

    def end_file(self, last: bool = False) -> Iterator[bytes]:
        if self.n_waiting:
            yield self._chunk(np.concatenate(self.waiting))
        if self.docs:
            padding = 0 if last else self.records - 1 - len(self.index)
            yield from [b""] * padding
            self.at += padding
            index, docs = np.array(self.index, "<i8").tobytes(), np.concatenate(self.docs, axis=1).astype("<i8").tobytes()
            body = zstandard.ZstdCompressor(level=self.level).compress(struct.pack("<QQQ", self.task << 32 | self.files, len(index), len(docs)) + index + docs)
            yield body + TAIL.pack(self.at, len(body), FOOTER)
            self.files += 1
        self._begin()


def write_token_files(
    docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, chunk_ids: int = 1 << 16, planes: int = BIT, level: int = 3, file_bytes: int = 128 << 20
) -> None:
    """Encode every whole text, add ``end_id`` to each and write the ids in ascending doc_id order.

    A task writes a range of doc_id and, within a doc_id, of a hash of the text, and begins a new file
    when one holds as many ids as take ``file_bytes`` at four bytes each; ``part`` numbers follow that
    order. So readers, which take a file at a time, stay within bounds whatever ranges hold; only a
    text of more ids has a larger file, of its own. Null texts are empty, null doc_ids come first, and
    rows with the same doc_id follow each other by that hash. An empty table gives empty files, which
    read back as no rows. Other columns are not looked at. ``path`` must be new; the write can run
    again after lost executors, as Spark's sink commits whole tasks only.
    """
    chunk_ids = max(1, min(chunk_ids, file_bytes // 8))
    records = max(2, 1 + file_bytes // (4 * chunk_ids))

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, maker = RunBpe.of(tokenizer), FileMaker(TaskContext.get().partitionId(), chunk_ids, records, planes, level)

        def rows(of: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
            for raw in of:
                yield pa.RecordBatch.from_arrays([pa.array([raw], pa.binary())], names=["value"])

        for batch in batches:
            for at, texts in steps(batch["text"]):
                ids, first = bpe.encode(texts)
                sizes = np.diff(first) + 1
                with_end = np.insert(ids, first[1:], end_id)
                own = batch["doc_id"].slice(at, len(texts))
                names = np.ma.masked_array(own.fill_null(0).to_numpy(), own.is_null().to_numpy(zero_copy_only=False))
                yield from rows(maker.add(names, with_end, sizes))
        yield from rows(maker.end_file(last=True))

    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    (
        own.repartitionByRange(_ranges(own, file_bytes), *order)
        .sortWithinPartitions(*order, "text")
        .mapInArrow(tidy(chunks), "value binary")
        .select(F.col("value").cast("string").alias("value"))
        .write.option("lineSep", "\n").option("maxRecordsPerFile", records).text(path)
    )


def _ranges(own: DataFrame, file_bytes: int) -> int:
    """Ranges of about ``file_bytes`` of text and ids; more, down to a mebibyte each, while tasks are fewer than twice the cores."""
    total = own.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + F.lit(64).cast("bigint"))).first()[0] or 0
    cores = own.sparkSession.sparkContext.defaultParallelism
    return max(1, -(-total // file_bytes), min(2 * cores, -(-total // (1 << 20))))


def _footer(raw: memoryview) -> tuple[int, np.ndarray, np.ndarray]:
    at, size, magic = TAIL.unpack_from(raw, len(raw) - TAIL.size - 1)
    if magic != FOOTER:
        raise ValueError("not a file of token planes, or cut short")
    body = zstandard.ZstdDecompressor().decompress(raw[at : at + size])
    part, n_index, n_docs = struct.unpack_from("<QQQ", body)
    index = np.frombuffer(body, "<i8", n_index // 8, 24).reshape(-1, 4)
    return part, index, np.frombuffer(body, "<i8", n_docs // 8, 24 + n_index).reshape(4, -1)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).where("length > 0").select("path", "content")


def chunk_index(spark: SparkSession, path: str) -> DataFrame:
    """The stored chunk index: path, part, chunk, byte_offset, byte_length, first_id (in its file), n_ids."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch["path"].to_pylist(), batch["content"]):
                part, index, _ = _footer(memoryview(raw.as_buffer()))
                k = len(index)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * k, pa.string()), pa.array([part] * k, pa.int64()), pa.array(np.arange(k)), *(pa.array(index[:, c]) for c in range(4))],
                    names=["path", "part", "chunk", "byte_offset", "byte_length", "first_id", "n_ids"],
                )

    return _files(spark, path).mapInArrow(rows, "path string, part bigint, chunk bigint, byte_offset bigint, byte_length bigint, first_id bigint, n_ids bigint")


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Read files of token planes: part, doc_id, local_start (in its file), n_tokens, ids_crc32 and, if asked, token_ids.

    Each file is decoded chunk by chunk; a document may span chunks.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch["content"]:
                raw = memoryview(content.as_buffer())
                part, index, docs = _footer(raw)
                held, begin, k = np.zeros(0, "<u4"), 0, 0
                crcs, lists = np.zeros(docs.shape[1], np.int64), []
                for i, (start, n) in enumerate(zip(docs[2].tolist(), docs[3].tolist())):
                    parts = [held[start - begin : start - begin + n]]
                    while begin + len(held) < start + n:
                        begin += len(held)
                        held = decode_chunk(raw[index[k, 0] : index[k, 0] + index[k, 1]])
                        k += 1
                        parts.append(held[: start + n - begin])
                    own = np.concatenate(parts) if len(parts) > 1 else parts[0]
                    crcs[i] = zlib.crc32(own.tobytes())
                    if with_ids:
                        lists.append(own.astype(np.int32))
                columns = [
                    pa.array(np.full(docs.shape[1], part)), pa.array(docs[0], mask=docs[1] == 1), pa.array(docs[2]), pa.array(docs[3]), pa.array(crcs),
                    *([pa.array(lists, pa.list_(pa.int32()))] if with_ids else []),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "doc_id", "local_start", "n_tokens", "ids_crc32", *["token_ids"] * with_ids])

    return _files(spark, path).mapInArrow(rows, DOCS + ", token_ids array<int>" * with_ids)


def document_index(spark: SparkSession, path: str) -> DataFrame:
    """Every document of the files with its place among all ids: doc_id, start, n_tokens, ids_crc32, part.

    The ids before a file are summed over one row per file; documents get theirs by a join on part.
    """
    docs = written(read_token_files(spark, path), "token-docs")
    totals = docs.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    bases = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    return docs.join(bases, "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32", "part")


def write_and_index(docs: DataFrame, tokenizer: str, end_id: int = 1, **how) -> DataFrame:
    """Write ``docs`` to new files of the shared folder and return what the files hold."""
    path = new_path(docs.sparkSession, "token-files")
    write_token_files(docs, path, tokenizer, end_id, **how)
    return document_index(docs.sparkSession, path)
