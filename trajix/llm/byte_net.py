"""A quality classifier: a convolutional network over the bytes of a whole text, in NumPy.

Bytes are embedded and cut into overlapping chunks that cover the whole text. Learned filters slide
over each chunk and are max-pooled within it; a hidden layer reads the pooled filters, and its
outputs, max-pooled and averaged over the chunks of the text, combine into one probability.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajix.llm.bpe_ids import steps, tidy


@dataclass(frozen=True)
class Shape:
    """Chunks of ``chunk`` bytes begin every ``chunk - overlap``; filters span ``width`` bytes and move by ``stride``."""

    chunk: int = 256
    overlap: int = 16
    width: int = 8
    stride: int = 2
    embed: int = 6
    filters: int = 48
    hidden: int = 24

    @property
    def step(self) -> int:
        return self.chunk - self.overlap

    @property
    def windows(self) -> int:
        return (self.chunk - self.width) // self.stride + 1


def chunks_of(raw: bytes, shape: Shape) -> np.ndarray:
    """All chunks of a text, as rows; the last is filled with zeros, and an empty text is one chunk of them."""
    n = max(1, -(-(len(raw) - shape.overlap) // shape.step))
    padded = np.zeros((n - 1) * shape.step + shape.chunk, np.uint8)
    padded[: len(raw)] = np.frombuffer(raw, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, shape.chunk)[:: shape.step]


class ByteNet:
    """Weights and both passes. Everything is 32-bit, so that weights travel as a small dictionary."""

    def __init__(self, shape: Shape, weights: dict[str, np.ndarray] | None = None, seed: int = 5):
        self.shape = shape
        if weights is None:
            rng = np.random.default_rng(seed)
            scale = lambda *s: (rng.normal(size=s) / np.sqrt(s[0])).astype(np.float32)
            weights = {
                "embed": rng.normal(size=(256, shape.embed)).astype(np.float32) * 0.5,
                "conv": scale(shape.width * shape.embed, shape.filters),
                "conv_b": np.zeros(shape.filters, np.float32),
                "hidden": scale(shape.filters, shape.hidden),
                "hidden_b": np.zeros(shape.hidden, np.float32),
                "out": scale(2 * shape.hidden, 1)[:, 0],
                "out_b": np.zeros(1, np.float32),
            }
        self.w = weights

    def _windows(self, chunks: np.ndarray) -> np.ndarray:
        s = self.shape
        seen = np.lib.stride_tricks.sliding_window_view(chunks, s.width, axis=1)[:, :: s.stride]
        return self.w["embed"][seen].reshape(-1, s.width * s.embed)

    def pooled(self, chunks: np.ndarray) -> np.ndarray:
        """Each chunk's filters, max-pooled over its windows."""
        s = self.shape
        answers = self._windows(chunks) @ self.w["conv"]
        return np.maximum(answers.reshape(len(chunks), s.windows, s.filters).max(1) + self.w["conv_b"], 0)

    def score(self, pooled: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Probability of each text from its chunks' pooled filters; ``first`` has where each text's chunks begin."""
        h = np.maximum(pooled @ self.w["hidden"] + self.w["hidden_b"], 0)
        n = np.diff(np.append(first, len(h)))
        both = np.concatenate([np.maximum.reduceat(h, first), np.add.reduceat(h, first) / n[:, None]], axis=1)
        return 1 / (1 + np.exp(-np.clip(both @ self.w["out"] + self.w["out_b"], -30, 30).astype(np.float64)))

    def score_texts(self, texts: list[bytes], most: int = 96) -> np.ndarray:
        """Scores of whole texts; ``most`` chunks are in memory at once, of however long a text."""
        parts, first, waiting, n = [], [], [], 0
        total = 0
        for raw in texts:
            rows = chunks_of(raw, self.shape)
            first.append(total)
            total += len(rows)
            for at in range(0, len(rows), most):
                waiting.append(rows[at : at + most])
                n += len(waiting[-1])
                if n >= most:
                    parts.append(self.pooled(np.concatenate(waiting)))
                    waiting, n = [], 0
        if waiting:
            parts.append(self.pooled(np.concatenate(waiting)))
        return self.score(np.concatenate(parts), np.array(first)) if first else np.zeros(0)

    def gradients(self, chunks: np.ndarray, first: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Weighted mean log loss of texts with marks ``y``, and its gradients."""
        s, w, c = self.shape, self.w, len(chunks)
        windows = self._windows(chunks)
        answers = (windows @ w["conv"]).reshape(c, s.windows, s.filters)
        top = answers.argmax(1)
        best = np.take_along_axis(answers, top[:, None], 1)[:, 0] + w["conv_b"]
        pooled = np.maximum(best, 0)
        pre = pooled @ w["hidden"] + w["hidden_b"]
        h = np.maximum(pre, 0)
        n = np.diff(np.append(first, c))
        owner = np.repeat(np.arange(len(y)), n)
        high = np.maximum.reduceat(h, first)
        both = np.concatenate([high, np.add.reduceat(h, first) / n[:, None]], axis=1)
        p = 1 / (1 + np.exp(-np.clip(both @ w["out"] + w["out_b"], -30, 30)))
        loss = -(weight * (y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9))).sum() / weight.sum()
        d = (weight * (p - y) / weight.sum()).astype(np.float32)
        g = {"out": both.T @ d, "out_b": d.sum(keepdims=True)}
        d_both = d[:, None] * w["out"]
        d_h = d_both[owner, s.hidden :] / n[owner, None]
        is_top = h == high[owner]
        ties = np.add.reduceat(is_top.astype(np.float32), first)
        d_h = (d_h + is_top * (d_both[:, : s.hidden] / ties)[owner]) * (pre > 0)
        g |= {"hidden": pooled.T @ d_h, "hidden_b": d_h.sum(0)}
        d_pool = (d_h @ w["hidden"].T) * (best > 0)
        g["conv_b"] = d_pool.sum(0)
        at = np.arange(c)[:, None] * s.windows + top
        rows, used = np.unique(at, return_inverse=True)
        d_answers = np.zeros((len(rows), s.filters), np.float32)
        d_answers[used.reshape(at.shape), np.arange(s.filters)] = d_pool
        g["conv"] = windows[rows].T @ d_answers
        d_embed = np.zeros_like(w["embed"])
        begin = rows % s.windows * s.stride
        seen = chunks[(rows // s.windows)[:, None], begin[:, None] + np.arange(s.width)]
        np.add.at(d_embed, seen.ravel(), (d_answers @ w["conv"].T).reshape(-1, s.embed))
        g["embed"] = d_embed
        return float(loss), g


def fit(texts: list[bytes], marks: list[int], shape: Shape, epochs: int = 8, least_steps: int = 600, batch: int = 32, chunks_each: int = 6, rate: float = 4e-3, seed: int = 5) -> ByteNet:
    """Train by Adam on the given texts, both marks with the same weight in all.

    There are ``epochs`` passes, more where these are under ``least_steps`` steps. A step sees at most ``chunks_each`` chunks of a text, drawn anew from all of them each time.
    With one mark alone the net gives that mark's probability to every text.
    """
    net, rng = ByteNet(shape, seed=seed), np.random.default_rng(seed)
    y = np.array(marks, np.float32)
    if len(y) == 0 or y.min() == y.max():
        net.w["out"][:] = 0
        net.w["out_b"][:] = 0 if len(y) == 0 else (8 if y[0] else -8)
        return net
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype(np.float32)
    cut = [chunks_of(t, shape) for t in texts]
    m, v = ({k: np.zeros_like(x) for k, x in net.w.items()} for _ in "mv")
    t = 0
    epochs = max(epochs, -(-least_steps * batch // len(y)))
    steps_all = epochs * -(-len(y) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            rows = [cut[i] if len(cut[i]) <= chunks_each else cut[i][rng.choice(len(cut[i]), chunks_each, replace=False)] for i in own]
            first = np.cumsum([0, *map(len, rows)])[:-1]
            _, g = net.gradients(np.concatenate(rows), first, y[own], weight[own])
            t += 1
            speed = rate * (1 - 0.9 * t / steps_all)
            for k in net.w:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                net.w[k] = (net.w[k] - speed * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return net


def in_holdout(doc_id: str) -> Column:
    """Rows whose labels training never sees: crc32 of the doc_id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, most_rows: int = 3000, most_bytes: int = 24 << 20, most_text_bytes: int = 384 << 10, shape: Shape = Shape(), seed: int = 5, **how) -> ByteNet:
    """Train on a bounded sample of the labelled rows outside the holdout.

    ``most_rows`` documents, half of each mark where there are enough, are the first by a seeded hash
    of the doc_id; of these, whole texts of up to ``most_text_bytes`` are taken while they fit in
    ``most_bytes``. Their sizes alone come to the driver first, so that it never gets more text than
    that. Null marks, null texts' rows and documents marked both ways are left out; of rows that
    share a doc_id, one takes part.
    """
    marks = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("lo"), F.max("quality").alias("hi")).where("lo = hi")
    marks = marks.where(~in_holdout("doc_id")).select(F.col("doc_id").alias("l_id"), F.col("lo").cast("int").alias("mark"), F.xxhash64(F.lit(seed), "doc_id").alias("h"))
    chosen = None
    for side in (0, 1):
        part = marks.where(F.col("mark") == side).orderBy("h", "l_id").limit(most_rows // 2)
        chosen = part if chosen is None else chosen.union(part)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text is not null").withColumn("size", F.octet_length("text"))
    named = rows.where(F.col("size") <= most_text_bytes).join(F.broadcast(chosen), F.col("doc_id") == F.col("l_id"))
    sized = named.groupBy("doc_id", "mark", "h").agg(F.min(F.struct("size", F.xxhash64("text").alias("t"))).alias("first")).select("doc_id", "mark", "h", "first.*").collect()
    fits, left = [], most_bytes
    for r in sorted(sized, key=lambda r: (r["h"], r["doc_id"])):
        if r["size"] <= left:
            fits.append((r["doc_id"], r["t"], r["mark"]))
            left -= r["size"]
    wanted = docs.sparkSession.createDataFrame(fits, "l_id bigint, t bigint, mark int")
    taken = rows.join(F.broadcast(wanted), (F.col("doc_id") == F.col("l_id")) & (F.xxhash64("text") == F.col("t"))).groupBy("l_id").agg(F.min("text").alias("text")).collect()
    texts = {r["l_id"]: r["text"].encode() for r in taken}
    return fit([texts[i] for i, _, _ in fits], [mark for _, _, mark in fits], shape, seed=seed, **how)


def score_documents(docs: DataFrame, net: ByteNet) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from a score of 0.5) of every row of ``docs``.

    Every byte of each text is read. A null text is an empty one; a null doc_id is scored and is not
    held out; repeated rows are scored each; an empty table gives no rows; columns other than doc_id
    and text are not looked at.
    """
    shape, weights = net.shape, net.w

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ByteNet(shape, weights)
        for batch in batches:
            for at, texts in steps(batch["text"]):
                ids = batch["doc_id"].slice(at, len(texts))
                held = [i is not None and zlib.crc32(str(i).encode()) % 3 == 1 for i in ids.to_pylist()]
                scores = own.score_texts(texts.cast(pa.large_binary()).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(held), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"]
                )

    chosen = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(tidy(rows), "doc_id bigint, held_out boolean, score double, predicted int")


def keep_documents(docs: DataFrame, net: ByteNet) -> DataFrame:
    """The rows of ``docs``, all columns, that score 0.5 or more.

    The verdict never leaves its row, so rows without a doc_id, and rows that share one, are judged each
    by their own text. A null text is an empty one; an empty table gives no rows.
    """
    shape, weights = net.shape, net.w

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ByteNet(shape, weights)
        for batch in batches:
            for at, texts in steps(batch["text"]):
                good = own.score_texts(texts.cast(pa.large_binary()).to_pylist()) >= 0.5
                if good.any():
                    yield batch.slice(at, len(texts)).filter(pa.array(good))

    return docs.mapInArrow(tidy(rows), docs.schema)
