"""Audit of how filters interact: what each removes in every order of applying them.

Documents are sorted by ranges of (fingerprint of the text, doc_id) and within a range by
(fingerprint, full text, doc_id), so equal texts are neighbours. The task that reads a range compares
each text with its predecessor and works out the failure mask of the other filters in the same pass. A
group of copies may go on over several ranges: each range hands on the texts of its last fingerprint,
and the first rows of a range look for theirs among those of earlier ranges. Masks then add up to
counters by part and mask, from which every order and step follows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajix.llm.bpe_ids import tidy
from trajix.llm.scratch import written

FILTERS = "ABCDE"
COPY = FILTERS.index("E")
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
UPPER = bytes(range(ord("A"), ord("Z") + 1))
CONTINUED = bytes(range(0x80, 0xC0))  # bytes of UTF-8 that begin no code point
BLANK = re.compile(rb"[ \t-\r]")
#: Bytes of a text whose words are split at a time.
STEP = 1 << 20
#: Rows of one batch that a task hands back.
BATCH_ROWS = 4096
FOUND = "pid int, edge int, tail boolean, part string, doc_id bigint, mask int, fp bigint, edge_text string"


@dataclass(frozen=True)
class Limits:
    """A: under ``min_words`` words. B: distinct words under ``distinct_percent`` % of the words. C: A-Z over
    ``upper_percent`` % of the code points. D: holds one of ``signs``. E, a copy, needs no limit."""

    min_words: int = 200
    distinct_percent: int = 50
    upper_percent: int = 3
    signs: bytes = b"#$%&*|"

    def mask(self, raw: bytes) -> int:
        """The bits of A to D that a text in UTF-8 fails."""
        n, distinct, at = 0, set(), 0
        while at < len(raw):
            cut = BLANK.search(raw, min(at + STEP, len(raw)))
            end = cut.start() if cut else len(raw)
            words = raw[at:end].split()
            n += len(words)
            distinct.update(words)
            at = max(end, at + 1)
        upper = len(raw) - len(raw.translate(None, UPPER))
        points = len(raw) - (0 if raw.isascii() else len(raw) - len(raw.translate(None, CONTINUED)))
        signs = len(raw.translate(None, self.signs)) < len(raw)
        fails = n < self.min_words, 100 * len(distinct) < self.distinct_percent * n, 100 * upper > self.upper_percent * points, signs
        return sum(bit << k for k, bit in enumerate(fails))


class _Range:
    """The sorted rows of one range, compared with their predecessors."""

    def __init__(self, limits: Limits, pid: int):
        self.limits, self.pid = limits, pid
        self.first_fp: int | None = None
        self.fp: int | None = None
        self.text: bytes | None = None
        self.least: int | None = None  # smallest doc_id of the run of equal texts
        self.open: list[bytes] = []  # texts of the fingerprint at hand that have a row with a doc_id
        self.edge = -1
        self.mask = 0
        self.rows: list[tuple] = []

    def add(self, fp: int, text: bytes, part: str, doc_id: int | None) -> None:
        if fp != self.fp:
            self.open = []
        if self.first_fp is None:
            self.first_fp = fp
        if fp != self.fp or text != self.text:
            self.fp, self.text, self.least, self.mask = fp, text, None, self.limits.mask(text)
        mask, edge = self.mask, None
        if doc_id is not None:
            if self.least is None:
                self.least = doc_id
                self.open.append(text)
                if fp == self.first_fp:
                    self.edge += 1
                    self.rows.append((self.pid, self.edge, False, None, None, None, fp, text))
            if self.least < doc_id:
                mask |= 1 << COPY
            elif fp == self.first_fp:
                edge = self.edge
        self.rows.append((self.pid, edge, None, part, doc_id, mask, None, None))

    def close(self) -> None:
        self.rows += [(self.pid, None, True, None, None, None, self.fp, text) for text in self.open]

    def taken(self) -> pa.RecordBatch:
        kinds = pa.int32(), pa.int32(), pa.bool_(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.binary()
        columns = [pa.array(c, t) for c, t in zip(zip(*self.rows) if self.rows else [[]] * 8, kinds)]
        columns[-1] = columns[-1].cast(pa.string())
        self.rows = []
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in FOUND.split(", ")])


def failure_masks(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """part, doc_id and mask (bit k set: the k-th of FILTERS fails) of every row of ``docs`` (doc_id, text, lang).

    A null text is empty; a null lang is the part ''. A text is a copy where an equal one has a smaller
    doc_id; rows that share doc_id and text are no copies of each other, and a row without a doc_id
    neither is one nor makes one. An empty table gives no rows; other columns are not looked at.
    """

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = _Range(limits, TaskContext.get().partitionId())
        for batch in batches:
            texts = batch["text"].cast(pa.large_binary())
            for fp, text, part, doc_id in zip(batch["fp"].to_pylist(), texts, batch["part"].to_pylist(), batch["doc_id"].to_pylist()):
                at.add(fp, text.as_py(), part, doc_id)
                if len(at.rows) >= BATCH_ROWS:
                    yield at.taken()
        at.close()
        yield at.taken()

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.xxhash64(text).alias("fp"), text.alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.col("doc_id").cast("bigint").alias("doc_id"))
    ranged = own.repartitionByRange("fp", F.col("doc_id").asc_nulls_first()).sortWithinPartitions("fp", "text", F.col("doc_id").asc_nulls_first())
    found = written(ranged.mapInArrow(tidy(compared), FOUND), "failure-masks")
    rows = found.where("tail is null").select("pid", "edge", "part", "doc_id", "mask")
    before = found.where("tail").groupBy("fp", "edge_text").agg(F.min("pid").alias("first_pid"))
    late = found.where("not tail").select("pid", "edge", "fp", "edge_text").join(before, ["fp", "edge_text"]).where("first_pid < pid").select("pid", "edge", F.lit(1 << COPY).alias("more"))
    # a row of ``late`` stands for a range and a text of its first fingerprint: one for each range but for equal fingerprints of unequal texts
    edges = rows.where("edge is not null").join(F.broadcast(late), ["pid", "edge"], "left").withColumn("mask", F.col("mask").bitwiseOR(F.coalesce("more", F.lit(0))))
    columns = ["part", "doc_id", "mask"]
    return rows.where("edge is null").select(columns).unionAll(edges.select(columns))


def mask_counts(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask and the documents n, of them good (a label of quality 1) and toxic (a label of toxic 1): at most 32 rows a part.

    Rows are added up before they meet the labels. Of labels that share a doc_id, any one counts.
    """
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("l_id")).agg(
        F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic")
    )
    slim = masks.groupBy("part", "doc_id", "mask").agg(F.count("*").alias("n"))
    both = slim.join(marks, F.col("doc_id") == F.col("l_id"), "left")
    added = lambda c: F.coalesce(F.sum(F.when(F.col(c), F.col("n"))), F.lit(0).cast("bigint")).alias(c)
    return both.groupBy("part", "mask").agg(F.sum("n").alias("n"), added("good"), added("toxic"))


def _orders() -> tuple[list[str], np.ndarray, np.ndarray]:
    """The orders by name; for each order and step, the bit of its filter and those of the filters before."""
    names = ["".join(p) for p in permutations(FILTERS)]
    bits = 1 << np.array([[FILTERS.index(c) for c in name] for name in names])
    return names, bits, np.cumsum(bits, axis=1) - bits


def by_order(counts: DataFrame) -> DataFrame:
    """part, filter_order, step and COUNTS from the counters of ``mask_counts``, 600 rows a part."""
    names, own, before = _orders()
    masks = np.arange(1 << len(FILTERS))
    fails, gone = (masks & own[..., None]) != 0, (masks & before[..., None]) != 0
    labels = pa.array(np.repeat(names, len(FILTERS)).tolist()), pa.array(np.tile(np.arange(1, len(FILTERS) + 1, dtype=np.int32), len(names)))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                n, good, toxic = np.zeros((3, len(masks)), np.int64)
                for c in r["counters"]:
                    n[c["mask"]], good[c["mask"]], toxic[c["mask"]] = c["n"], c["good"], c["toxic"]
                here = fails & ~gone
                removed = here @ n
                shapley = {int(f): int(removed[own == f].sum()) for f in own[0]}
                values = [(~fails & ~gone) @ n, removed, (fails & gone) @ n, n[own], here @ good, here @ toxic, np.vectorize(shapley.get)(own)]
                yield pa.RecordBatch.from_arrays([pa.array([r["part"]] * own.size), *labels, *(pa.array(v.ravel().astype(np.int64)) for v in values)], names=["part", "filter_order", "step", *COUNTS])

    by_part = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("counters"))
    return by_part.mapInArrow(rows, "part string, filter_order string, step int, " + ", ".join(f"{c} bigint" for c in COUNTS))


def audit_filters(docs: DataFrame, labels: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """What each filter keeps and removes, by part, order of the filters and step.

    Nulls, repeated rows and empty tables are taken as ``failure_masks`` and ``mask_counts`` say; a table
    without rows has no parts and gives no rows. Null labels are neither good nor toxic.
    """
    return by_order(mask_counts(failure_masks(docs, limits), labels))
