"""SentencePiece encoding by a unigram model, and decoding.

Pieces and their log scores come from a model file. A double-array trie holds the pieces' bytes. The
best segmentation of a text is the path of the largest sum of scores (Viterbi); a character that no
piece covers alone costs the smallest score less ten and is spelled in byte pieces. Pieces marked as
unused are never chosen; a user-defined one has the largest score for each of its bytes. No piece of such
models goes on across a space marker that follows other characters, so a text's best path is that of
its words, each with the markers before it. Words are found and named by Arrow, and all new words of
a batch go through the trie together, position by position, in NumPy.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajix.llm.bpe_ids import steps, tidy

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: What an unknown character costs beyond the smallest score, and what a user's piece costs beyond the largest score of each of its bytes.
PENALTY, BONUS = 10.0, 0.1
MOST_WORDS = 800_000
#: Bytes from which on a word is walked alone, and is not kept; bytes of it whose pieces are found together.
LONG_WORD, WALK_STEP = 4_096, 1 << 16
WINDOW = 2048


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = raw[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            value: int | bytes = varint()
        else:
            size = varint() if kind == 2 else 4 if kind == 5 else 8
            value = raw[at : at + size]
            at += size
        yield tag >> 3, value


@dataclass(frozen=True)
class Model:
    """Pieces in the order of their ids, with scores and types, and what the normaliser does."""

    pieces: list[str]
    scores: np.ndarray
    types: np.ndarray
    dummy_prefix: bool
    trims: bool

    @classmethod
    def read(cls, path: str) -> "Model":
        """Read a model file. Its character map is not used: only models that leave characters as they are fit."""
        pieces, scores, types, prefix, trims = [], [], [], True, True
        with open(path, "rb") as f:
            raw = f.read()
        for number, value in _fields(raw):
            if number == 1:
                own = dict(_fields(value))
                pieces.append(own[1].decode())
                scores.append(struct.unpack("<f", own.get(2, b"\0\0\0\0"))[0])
                types.append(own.get(3, NORMAL))
            elif number == 3:
                spec = dict(_fields(value))
                prefix, trims = bool(spec.get(3, 1)), bool(spec.get(4, 1))
                if spec.get(2):
                    raise ValueError("the model maps characters")
        return cls(pieces, np.array(scores), np.array(types), prefix, trims)


class DoubleArray:
    """A trie in two arrays: a node's child by byte c is at base[node] + c if check there names the node."""

    def __init__(self, keys: dict[bytes, int]):
        children: list[dict[int, int]] = [{}]
        value = [-1]
        for key, v in keys.items():
            node = 0
            for c in key:
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                    value.append(-1)
                node = children[node][c]
            value[node] = v
        size = len(children) * 3 + 2 * WINDOW
        self.base, self.check, self.value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        taken = np.zeros(size, bool)
        taken[0] = True
        place, low = [0] * len(children), 1
        queue = [0]
        for node in queue:
            at = place[node]
            self.value[at] = value[node]
            own = sorted(children[node])
            if not own:
                continue
            while taken[low]:
                low += 1
            begin = max(1, low - own[0])
            while True:  # the first base, of a window at a time, whose slots are free
                if begin + WINDOW + 256 > len(taken):
                    grow = len(taken)
                    taken = np.append(taken, np.zeros(grow, bool))
                    self.base, self.check, self.value = (np.append(a, np.full(grow, fill, np.int32)) for a, fill in ((self.base, 0), (self.check, -1), (self.value, -1)))
                clash = np.logical_or.reduce([taken[begin + c : begin + c + WINDOW] for c in own])
                k = int(clash.argmin())
                if not clash[k]:
                    break
                begin += WINDOW
            base = begin + k
            self.base[at] = base
            for c in own:
                taken[base + c] = True
                self.check[base + c] = at
                place[children[node][c]] = base + c
                queue.append(children[node][c])
        pad = np.full(256, -1, np.int32)  # so that every step stays inside
        self.base, self.check, self.value = np.append(self.base, pad * 0), np.append(self.check, pad), np.append(self.value, pad)

    def child(self, nodes: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The children by a byte each; -1 for none."""
        at = self.base[nodes] + codes
        return np.where((self.check[at] == nodes) & (nodes >= 0), at, -1)


class Unigram:
    """Encoder and decoder of one process."""

    _made: dict[str, "Unigram"] = {}

    @classmethod
    def of(cls, path: str) -> "Unigram":
        if path not in cls._made:
            cls._made[path] = cls(Model.read(path))
        return cls._made[path]

    def __init__(self, model: Model):
        self.model = model
        usable = [i for i, t in enumerate(model.types) if t in (NORMAL, USER) and model.pieces[i]]
        for i in usable:
            if MARK in model.pieces[i].lstrip(MARK):
                raise ValueError("a piece goes on across a space marker")
        self.trie = DoubleArray({model.pieces[i].encode(): i for i in usable})
        normal = model.scores[model.types == NORMAL]
        top = normal.max() if len(normal) else 0.0
        # a user's piece beats any split of its bytes into normal pieces but one into the best piece of each byte
        self.scores = np.array([len(p.encode()) * top - BONUS if t == USER else s for p, s, t in zip(model.pieces, model.scores, model.types)])
        self.unknown_score = (model.scores[model.types == NORMAL].min() if (model.types == NORMAL).any() else 0.0) - PENALTY
        self.unknown_id = int(np.flatnonzero(model.types == UNKNOWN)[0]) if (model.types == UNKNOWN).any() else 0
        self.bytes_of = {int(p[1:-1], 16): i for i, p in enumerate(model.pieces) if model.types[i] == BYTE}
        self.words: dict[bytes, bytes] = {b"": b""}

    def best_paths(self, words: list[bytes]) -> list[bytes]:
        """Ids, as little-endian 32-bit integers, of each word's best segmentation; ties go to the longer piece."""
        out: list[bytes] = [b""] * len(words)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        while order and len(words[order[-1]]) > LONG_WORD:
            i = order.pop()
            out[i] = self._walk(words[i])
        at = 0
        while at < len(order):  # words of like length together
            longest = len(words[order[at]])
            end = at
            while end < len(order) and end - at < max(1, 2_000_000 // max(1, longest)) and len(words[order[end]]) <= max(16, 2 * longest):
                end += 1
            own = order[at:end]
            for i, ids in zip(own, self._viterbi([words[i] for i in own])):
                out[i] = ids
            at = end
        return out

    def _viterbi(self, words: list[bytes]) -> list[bytes]:
        n, size = len(words), max(map(len, words))
        text = np.zeros((size + 1, n), np.uint8)
        flat = np.frombuffer(b"".join(w.ljust(size, b"\0") for w in words), np.uint8).reshape(n, size)
        text[:size] = flat.T
        length = np.fromiter(map(len, words), np.int64, n)
        lead = np.full(256, 1)
        lead[0xC0:0xE0], lead[0xE0:0xF0], lead[0xF0:] = 2, 3, 4
        best = np.full((size + 1, n), -np.inf)
        best[0] = 0
        came, piece = np.zeros((size + 1, n), np.int32), np.full((size + 1, n), -1, np.int32)
        for i in range(size):
            live = np.flatnonzero((length > i) & (text[i] & 0xC0 != 0x80))
            if not len(live):
                continue
            width = np.minimum(lead[text[i, live]], length[live] - i)
            alone = np.zeros(len(live), bool)
            nodes, on = np.zeros(len(live), np.int32), np.arange(len(live))
            depth = 0
            while len(on):
                inside = i + depth < length[live[on]]
                on, nodes = on[inside], nodes[inside]
                nodes = self.trie.child(nodes, text[i + depth, live[on]].astype(np.int32))
                met = nodes >= 0
                on, nodes = on[met], nodes[met]
                depth += 1
                ids = self.trie.value[nodes]
                ends = ids >= 0
                if ends.any():
                    who, which = on[ends], ids[ends]
                    alone[who[width[who] == depth]] = True
                    self._relax(best, came, piece, i, i + depth, live[who], which, self.scores[which])
            rest = np.flatnonzero(~alone)
            for w in np.unique(width[rest]):
                who = live[rest[width[rest] == w]]
                self._relax(best, came, piece, i, i + int(w), who, np.full(len(who), -2), np.full(len(who), self.unknown_score))
        # walk all paths back together; words with unknown characters are walked one by one
        every, end, back = np.arange(n), length.copy(), []
        while end.any():
            back.append(np.where(end > 0, piece[end, every], -1))
            end = np.where(end > 0, came[end, every], 0)
        ids = np.array(back[::-1], np.int64).reshape(-1, n).T
        flat, counts = ids[ids != -1].astype("<u4").tobytes(), np.cumsum((ids != -1).sum(1)).tolist()
        out = [flat[4 * i : 4 * j] for i, j in zip([0, *counts], counts)]
        for k in np.flatnonzero((ids == -2).any(1)).tolist():
            out[k] = self._trace(words[k], came[:, k], piece[:, k])
        return out

    def _walk(self, word: bytes) -> bytes:
        """The best segmentation of one long word: the pieces at many positions are found together, and tried one by one."""
        size, text = len(word), np.frombuffer(word, np.uint8)
        best, came, piece = array("d", [-np.inf]) * (size + 1), array("i", [0]) * (size + 1), array("i", [-1]) * (size + 1)
        best[0] = 0.0
        lead = np.ones(256, np.int64)
        lead[0xC0:0xE0], lead[0xE0:0xF0], lead[0xF0:] = 2, 3, 4
        for begin in range(0, size, WALK_STEP):
            part = text[begin : begin + WALK_STEP]
            start = np.flatnonzero(part & 0xC0 != 0x80) + begin
            width = np.minimum(lead[text[start]], size - start)
            alone, on, nodes, depth = np.zeros(len(start), bool), np.arange(len(start)), np.zeros(len(start), np.int32), 0
            found = []
            while len(on):
                inside = start[on] + depth < size
                on, nodes = on[inside], nodes[inside]
                nodes = self.trie.child(nodes, text[start[on] + depth].astype(np.int32))
                on, nodes = on[nodes >= 0], nodes[nodes >= 0]
                depth += 1
                ids = self.trie.value[nodes]
                who = on[ids >= 0]
                alone[who[width[who] == depth]] = True
                found.append((start[who], start[who] + depth, ids[ids >= 0], self.scores[ids[ids >= 0]]))
            rest = ~alone
            found.append((start[rest], (start + width)[rest], np.full(rest.sum(), -2), np.full(rest.sum(), self.unknown_score)))
            i, j, ids, scores = (np.concatenate(c) for c in zip(*found))
            order = np.argsort(i, kind="stable")
            for a, b, which, score in zip(i[order].tolist(), j[order].tolist(), ids[order].tolist(), scores[order].tolist()):
                reached = best[a] + score
                if reached > best[b]:
                    best[b], came[b], piece[b] = reached, a, which
        return self._trace(word, came, piece)

    @staticmethod
    def _relax(best, came, piece, begin: int, end: int, who, ids, scores) -> None:
        reached = best[begin, who] + scores
        better = reached > best[end, who]
        who = who[better]
        best[end, who], came[end, who], piece[end, who] = reached[better], begin, ids[better]

    def _trace(self, word: bytes, came: np.ndarray, piece: np.ndarray) -> bytes:
        ids, end = [], len(word)
        while end:
            begin = int(came[end])
            if piece[end] >= 0:
                ids.append(int(piece[end]))
            elif self.bytes_of:
                ids += [self.bytes_of[c] for c in reversed(word[begin:end])]
            else:
                ids.append(self.unknown_id)
            end = begin
        return np.array(ids[::-1], "<u4").tobytes()

    def _prepared(self, texts: pa.LargeStringArray) -> pa.LargeStringArray:
        """Texts with markers for spaces, and one before each text if the model asks for it."""
        import pyarrow.compute as pc

        if self.model.trims:
            texts = pc.utf8_trim(pc.replace_substring_regex(texts, " +", " "), " ")
        marked = pc.replace_substring(texts, " ", MARK)
        if self.model.dummy_prefix:
            marked = pc.if_else(pc.equal(pc.binary_length(texts), 0), marked, pc.binary_join_element_wise(pa.scalar(MARK, pa.large_string()), marked, pa.scalar("", pa.large_string())))
        return marked

    def encode(self, texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (none null) and, with one more entry than texts, where each text's begin."""
        marked = self._prepared(texts).combine_chunks() if isinstance(texts, pa.ChunkedArray) else self._prepared(texts)
        _, offsets, data = marked.buffers()
        first = np.frombuffer(offsets, np.int64, len(marked) + 1, marked.offset * 8)
        raw = np.frombuffer(data, np.uint8)[first[0] : first[-1]] if data else np.zeros(0, np.uint8)
        first = first - first[0]
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        mark = np.frombuffer(MARK.encode(), np.uint8)
        starts = np.zeros(len(raw), bool)
        starts[: len(raw) - 2] = (raw[:-2] == mark[0]) & (raw[1:-1] == mark[1]) & (raw[2:] == mark[2])
        cut = np.zeros(len(raw) + 1, bool)
        cut[:-1] = starts
        cut[3:-1] &= ~starts[:-3]  # a run of markers stays with the word behind it
        cut[first] = True
        at = np.flatnonzero(cut)
        named = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(raw)]).dictionary_encode()
        _, o, d = named.dictionary.buffers()
        where, whole = np.frombuffer(o, np.int64, len(named.dictionary) + 1).tolist(), d.to_pybytes()
        names = [whole[i:j] for i, j in zip(where, where[1:])]
        if len(self.words) > MOST_WORDS:
            self.words = {b"": b""}
        new = [w for w in names if w not in self.words]
        self.words.update(zip(new, self.best_paths(new)))
        parts = [self.words[w] for w in names]
        for w in new:
            if len(w) > LONG_WORD:
                del self.words[w]
        size = np.fromiter(map(len, parts), np.int64, len(parts)) >> 2
        flat = np.frombuffer(b"".join(parts), "<u4")
        which = named.indices.to_numpy()
        n = size[which]
        ends = np.zeros(len(n) + 1, np.int64)
        np.cumsum(n, out=ends[1:])
        take = np.repeat((np.cumsum(size) - size)[which] - ends[:-1], n)
        take += np.arange(len(take))
        return flat[take], ends[np.searchsorted(at, first)]

    def decode(self, ids: np.ndarray) -> str:
        """The text of some ids: byte pieces are bytes, markers spaces, and the first marker goes if the encoder adds one."""
        if not hasattr(self, "raw_of"):
            raws = [b"" if t == CONTROL else bytes([int(p[1:-1], 16)]) if t == BYTE else " ⁇ ".encode() if t == UNKNOWN else p.encode() for p, t in zip(self.model.pieces, self.model.types)]
            self.raw_of = np.array(raws, object)
        text = b"".join(self.raw_of[ids]).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if self.model.dummy_prefix and text.startswith(" ") else text


def encode_documents(docs: DataFrame, model_path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, n_bytes_spelled (tokens of byte pieces), ids_crc32 and, with ``with_ids``, token_ids of each row's whole text.

    A null or empty text has no ids; a null doc_id stays null; repeated rows are encoded each; an
    empty table gives no rows; columns other than doc_id and text are not looked at.
    """
    return _run(docs, model_path, with_ids, False)


def decode_documents(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id and the text of each row's token_ids; null ids give an empty text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Unigram.of(model_path)
        for batch in batches:
            texts = [model.decode(np.array(ids or [], np.int64)) for ids in batch["token_ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("token_ids").cast("array<int>").alias("token_ids")).mapInArrow(rows, "doc_id bigint, text string")


def round_trips(docs: DataFrame, model_path: str) -> DataFrame:
    """What ``encode_documents`` says of each row, and decoded_sha256 of the text that its ids decode to."""
    return _run(docs, model_path, False, True)


def _run(docs: DataFrame, model_path: str, with_ids: bool, decoded: bool) -> DataFrame:
    import hashlib

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Unigram.of(model_path)
        spelled = model.model.types == BYTE
        for batch in batches:
            for at, texts in steps(batch["text"]):
                ids, first = model.encode(texts)
                bytes_before = np.append(0, np.cumsum(spelled[ids]))
                spans = list(zip(first[:-1].tolist(), first[1:].tolist()))
                columns = {
                    "doc_id": batch["doc_id"].slice(at, len(texts)),
                    "n_tokens": pa.array(np.diff(first)),
                    "n_bytes_spelled": pa.array(bytes_before[first[1:]] - bytes_before[first[:-1]]),
                    "ids_crc32": pa.array([zlib.crc32(ids[i:j].tobytes()) for i, j in spans], pa.int64()),
                }
                if with_ids:
                    columns["token_ids"] = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids.astype(np.int32)))
                if decoded:
                    columns["decoded_sha256"] = pa.array([hashlib.sha256(model.decode(ids[i:j]).encode()).hexdigest() for i, j in spans], pa.string())
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    schema = "doc_id bigint, n_tokens bigint, n_bytes_spelled bigint, ids_crc32 bigint" + ", token_ids array<int>" * with_ids + ", decoded_sha256 string" * decoded
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(rows), schema)
