"""Packing of documents into training sequences of a fixed capacity.

Each document's ids are made where its text lies and cut into pieces: as many full sequences as
they fill, and one remainder. Only the pieces' keys and lengths move. They are written, dealt into
groups by a seeded hash of their place in that table, so that equal rows spread like any others, and
each group is packed on its own by first-fit decreasing, with a tournament tree over the bins' free
capacity that finds the leftmost bin with room in a logarithm of their number.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajix.llm.bpe_ids import RunBpe, steps, tidy
from trajix.llm.scratch import written

PIECE = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


class BinTree:
    """Tournament tree over the free capacity of bins: each inner node holds its children's larger one."""

    def __init__(self, bins: int, capacity: int):
        self.width = 1 << max(0, bins - 1).bit_length()
        self.free = [capacity] * (2 * self.width)

    def put(self, size: int) -> tuple[int, int]:
        """Put an item into the first bin with room; returns the bin and its fill before. Size at most the capacity."""
        free, node = self.free, 1
        while node < self.width:
            node *= 2
            if free[node] < size:
                node += 1
        bin_, room = node - self.width, free[node]
        free[node] = room - size
        node >>= 1
        while node:
            best = max(free[2 * node], free[2 * node + 1])
            if free[node] == best:
                break
            free[node] = best
            node >>= 1
        return bin_, room


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item; longer items go first, equal ones in their given order."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    order = np.argsort(-lengths, kind="stable")
    full = int((lengths == capacity).sum())
    bins[order[:full]] = np.arange(full)
    tree = BinTree(len(lengths) - full, capacity)
    for i, size in zip(order[full:].tolist(), lengths[order[full:]].tolist()):
        bin_, room = tree.put(size)
        bins[i], offsets[i] = full + bin_, capacity - room
    return bins, offsets


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, with_ids: bool = False) -> DataFrame:
    """Cut each document's ids, with ``end_id`` behind them, at each multiple of ``capacity``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = RunBpe.of(tokenizer)
        for batch in batches:
            for at, texts in steps(batch["text"]):
                ids, first = bpe.encode(texts)
                rows = [[] for _ in range(6)]
                for k in range(len(texts)):
                    own = np.append(ids[first[k] : first[k + 1]], end_id).astype("<u4")
                    doc = batch["doc_id"][at + k].as_py()
                    for start in range(0, len(own), capacity):
                        part = own[start : start + capacity]
                        for column, value in zip(rows, (doc, start, len(part), zlib.crc32(part.tobytes()), len(own), part)):
                            column.append(value)
                columns = [pa.array(c, pa.int64()) for c in rows[:5]]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:
                    columns.append(pa.array([p.astype(np.int32) for p in rows[5]], pa.list_(pa.int32())))
                    names.append("token_ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    chosen = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(tidy(cut), PIECE + ", token_ids array<int>" * with_ids)


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = 4096,
    end_id: int = 2,
    docs_per_group: int = 20_000,
    seed: int = 17,
    with_ids: bool = False,
) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens.

    Returns a row per piece: doc_id, start (ids of its document before it), length, ids_crc32
    (unsigned, of the ids as little-endian unsigned 32-bit integers), doc_tokens, sequence_id,
    offset (in the sequence), sequence_length, padding and, with ``with_ids``, token_ids.
    A sequence is padded to ``capacity`` unless its length is a power of two.

    A null or empty text is a document of the end id alone. A null doc_id stays null and packs like
    any other; repeated rows are documents of their own. An empty table gives no rows; columns
    other than doc_id and text are not looked at. Ties in length go by doc_id, start and crc. A group
    has about ``docs_per_group`` pieces.
    """
    cut = written(pieces(docs, tokenizer, end_id, capacity, with_ids), "pieces")
    groups = max(1, -(-cut.count() // docs_per_group))
    schema = PIECE + ", token_ids array<int>" * with_ids
    out = f"{schema}, sequence_id bigint, offset bigint, sequence_length bigint, padding bigint"

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("doc_id", "start", "ids_crc32")])
        lengths = table["length"].to_numpy()
        bins, offsets = first_fit_decreasing(lengths, capacity)
        used = np.bincount(bins, lengths).astype(np.int64)
        padding = np.where(used & (used - 1) == 0, 0, capacity - used)
        group = key[0].as_py()
        for name, column in (("sequence_id", bins + (group << 32)), ("offset", offsets), ("sequence_length", used[bins]), ("padding", padding[bins])):
            table = table.append_column(name, pa.array(column, pa.int64()))
        return table.drop_columns(["pack_group"])

    dealt = cut.withColumn("pack_group", F.pmod(F.xxhash64(F.lit(seed), F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy("pack_group").applyInArrow(pack, out)
