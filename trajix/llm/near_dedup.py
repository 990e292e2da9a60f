"""Near-duplicate documents by SetSketch registers.

A document's set of word shingles is sketched by registers floor(1 - log_b(h)), where h is the
smallest of exponentially distributed hashes of the shingles, held between 0 and q + 1. Registers of
a union are the larger ones of its parts, and registers of similar sets are often equal, so runs of
registers serve as bands of a locality-sensitive index. Texts with the same words are one node from
the start. Shingles that one node has alone bound what it can reach; nodes that can reach nothing
drop out here. Within a band's bucket each node is compared with one hub, the node with the smallest
share of shingles of its own, which takes a row for each member. Nodes that hubs have left in
different components are then compared with each other where what each lacks of the hub allows it,
in cells of a bounded number of nodes on either side.
Pairs whose registers make the asked similarity very unlikely, by the joint likelihood of larger,
smaller and equal registers, are left out, and the rest are confirmed on their full sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajix.llm import word_hash
from trajix.llm.bpe_ids import steps, tidy
from trajix.llm.components import components
from trajix.llm.scratch import join_counted, only_ids, written

BLOCK = 1 << 16
#: Nodes of an open bucket that meet as many others in one join key.
CELL_NODES, CELL = 1_000, ("cell_row", "cell_column")


@dataclass(frozen=True)
class SetSketch:
    """Parameters: ``bands`` times ``rows`` registers of base b and rate a, from 0 to q + 1 (two bytes each)."""

    bands: int = 40
    rows: int = 5
    b: float = 1.001
    a: float = 20.0
    q: int = 65533
    seed: int = 41
    #: Candidates whose similarity is less likely than this, as the logarithm of a ratio, are left out; infinity leaves out none.
    slack: float = 20.0

    @property
    def m(self) -> int:
        return self.bands * self.rows

    def registers(self, values: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Registers, one row for each set; ``values`` holds the sets' hashes one after another. Empty sets have zeros."""
        rng = np.random.default_rng(self.seed)
        flips = rng.integers(0, 2**64, self.m, np.uint64)
        factors = rng.integers(0, 2**64, self.m, np.uint64) | np.uint64(1)
        n = np.diff(first)
        out = np.zeros((len(n), self.m), np.uint16)
        filled = np.flatnonzero(n)
        at = 0
        while at < len(filled):  # blocks that stay in the processor's cache
            begin = first[filled[at]]
            end = max(at + 1, int(np.searchsorted(first[filled + 1], begin + BLOCK, "right")))
            own = filled[at:end]
            part = values[begin : first[own[-1] + 1]]
            starts = first[own] - begin
            top = np.empty((self.m, len(own)), np.uint64)
            for i in range(self.m):
                np.maximum.reduceat((part ^ flips[i]) * factors[i], starts, out=top[i])
            gap = ((~top).astype(np.float64) + 0.5) / 2.0**64  # the largest hash is 1 - gap of the way up
            h = -np.log1p(-np.minimum(gap, 1 - 1e-16)) / self.a
            out[own] = np.clip(np.floor(1 - np.log(h) / log(self.b)), 0, self.q + 1).T.astype(np.uint16)
            at = end
        return out

    def merge(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Registers of the union of two sets."""
        return np.maximum(x, y)

    def band_keys(self, registers: np.ndarray) -> np.ndarray:
        """A 64-bit key for each set and band."""
        grouped = registers.reshape(-1, self.bands, self.rows).astype(np.uint64)
        keys = np.broadcast_to(word_hash.mix(np.arange(1, self.bands + 1, dtype=np.uint64) * word_hash.MIX[0]), grouped.shape[:2])
        for k in range(self.rows):
            keys = word_hash.mix(keys * word_hash.MIX[1] + grouped[:, :, k] + np.uint64(1))
        return keys

    def log_likelihood(self, j, u, v, more, fewer, same):
        """Of similarity j, from the sets' shares u and v of their sizes' sum and the counts of compared registers."""

        def p(x):
            return -np.log1p(-np.clip(x, 0, 1) * (self.b - 1) / self.b) / log(self.b)

        up, down = p(u - v * j), p(v - u * j)
        tiny = 1e-300
        return more * np.log(np.maximum(up, tiny)) + fewer * np.log(np.maximum(down, tiny)) + same * np.log(np.maximum(1 - up - down, tiny))

    def estimate(self, x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Similarity of maximal joint likelihood for each pair of rows, given the sets' sizes; and what it came from."""
        more, fewer = (x > y).sum(1), (x < y).sum(1)
        u = nx / (nx + ny)
        v = 1 - u
        known = (u, v, more, fewer, self.m - more - fewer)
        low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
        for _ in range(50):  # the likelihood has one maximum
            left, right = low + (high - low) / 3, high - (high - low) / 3
            up = self.log_likelihood(left, *known) < self.log_likelihood(right, *known)
            low, high = np.where(up, left, low), np.where(up, high, right)
        return (low + high) / 2, known

    def may_reach(self, x, y, nx, ny, similarity: float) -> np.ndarray:
        """Pairs whose likelihood at ``similarity`` is not below exp(-slack) of its maximum, or that are estimated above it."""
        if np.isinf(self.slack):
            return np.ones(len(nx), bool)
        best, known = self.estimate(x, y, nx, ny)
        reach = np.minimum(similarity, np.minimum(known[0] / known[1], known[1] / known[0]))
        return (best >= similarity) | (self.log_likelihood(best, *known) - self.log_likelihood(reach, *known) <= self.slack)


def _own(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def sketches(docs: DataFrame, size: int, sketch: SetSketch) -> DataFrame:
    """doc_id, n (its set's size), words_key, registers and t (a hash of the text) of each row of ``docs``."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in steps(batch["text"]):
                hashes, first = word_hash.words(texts)
                values, begin = word_hash.shingles(hashes, first, size)
                registers = sketch.registers(values, begin)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["doc_id"].slice(at, len(texts)),
                        pa.array(np.diff(begin), pa.int64()),
                        pa.array(word_hash.sequence_keys(hashes, first), pa.binary()),
                        pa.array([r.tobytes() for r in registers], pa.binary()),
                        batch["t"].slice(at, len(texts)),
                    ],
                    names=["doc_id", "n", "words_key", "registers", "t"],
                )

    return _own(docs).withColumn("t", F.xxhash64("text")).mapInArrow(tidy(rows), "doc_id bigint, n bigint, words_key binary, registers binary, t bigint")


def shingle_sets(docs: DataFrame, size: int) -> DataFrame:
    """doc_id and its set of shingle hashes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in steps(batch["text"]):
                values, begin = word_hash.shingles(*word_hash.words(texts), size)
                sets = pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(values.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(at, len(texts)), sets], names=["doc_id", "shingles"])

    return _own(docs).mapInArrow(tidy(rows), "doc_id bigint, shingles array<bigint>")


def _bands(nodes: DataFrame, sketch: SetSketch) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            registers = np.frombuffer(b"".join(batch["registers"].to_pylist()), np.uint16).reshape(-1, sketch.m)
            keys = sketch.band_keys(registers)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys.ravel().view(np.int64)),
                    pa.array(np.tile(np.arange(sketch.bands, dtype=np.int32), len(registers))),
                    pa.array(np.repeat(batch["node"].to_numpy(), sketch.bands)),
                ],
                names=["key", "band", "node"],
            )

    return nodes.select("node", "registers").mapInArrow(rows, "key bigint, band int, node bigint")


def _likely(pairs: DataFrame, nodes: DataFrame, sketch: SetSketch, percent: int) -> DataFrame:
    """Pairs (a, b) that their sizes and registers allow to reach the similarity."""
    x = nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("registers").alias("ra"))
    y = nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("registers").alias("rb"))
    pairs = written(pairs, "pairs")
    sized = join_counted(join_counted(pairs, x, "a", _count(pairs, "a")), y, "b", _count(pairs, "b")).where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ra, rb = (np.frombuffer(b"".join(batch[c].to_pylist()), np.uint16).reshape(-1, sketch.m) for c in ("ra", "rb"))
                fits = sketch.may_reach(ra, rb, batch["na"].to_numpy(), batch["nb"].to_numpy(), percent / 100)
                yield batch.select(["a", "b"]).filter(pa.array(fits))

    return sized.mapInArrow(rows, "a bigint, b bigint").distinct()


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets reach the similarity."""
    both = _with_sets(pairs, sets).select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("i"))
    return both.where(_reaches(F.col("i"), F.col("na"), F.col("nb"), percent)).select("a", "b").distinct()


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    x, y = (sets.select(F.col("doc_id").alias(c), F.col("shingles").alias(f"s{c}")) for c in "ab")
    pairs = written(pairs, "pairs")
    return join_counted(join_counted(pairs, x, "a", _count(pairs, "a")), y, "b", _count(pairs, "b"))


def _count(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("rows"))


def _reaches(common: Column, na: Column, nb: Column, percent: int) -> Column:
    return 100 * common >= percent * (na + nb - common)


def _signature(values: Column, half: int) -> Column:
    """64 bits, one of which each value whose bit 6 is ``half`` sets."""
    bit = lambda v: F.call_function("shiftleft", F.lit(1).cast("bigint"), v.bitwiseAND(F.lit(63)).cast("int"))
    own = F.filter(values, lambda v: v.bitwiseAND(F.lit(64)) == 64 * half)
    return F.aggregate(own, F.lit(0).cast("bigint"), lambda acc, v: acc.bitwiseOR(bit(v)))


def _against_hub(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """For pairs (node, hub): their sizes and common shingles, and a signature of what the hub has beyond the node."""
    both = _with_sets(pairs.select(F.col("node").alias("a"), F.col("hub").alias("b")), sets).withColumn("lacks", F.array_except("sb", "sa"))
    sizes = F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("i")
    return both.select(F.col("a").alias("node"), F.col("b").alias("hub"), *sizes, F.size("lacks").alias("lacks"), _signature(F.col("lacks"), 0).alias("s0"), _signature(F.col("lacks"), 1).alias("s1"))


def _most_common(hub: Column, x: dict[str, Column], y: dict[str, Column]) -> Column:
    """An upper bound of the shingles that two nodes of a bucket have in common.

    Within the hub they have what neither lacks, and what both lack sets the same signature bits;
    beyond the hub only shingles count that no node has alone. Null where one was not compared with
    the hub.
    """
    same = F.bit_count(x["s0"].bitwiseAND(y["s0"])) + F.bit_count(x["s1"].bitwiseAND(y["s1"]))
    folded = F.least(*[n["lacks"] - F.bit_count(n["s0"]) - F.bit_count(n["s1"]) for n in (x, y)])
    beyond = F.least(*[n["n"] - n["i"] - n["alone"] for n in (x, y)])
    return hub - x["lacks"] - y["lacks"] + same + folded + beyond


def _dealt(left: DataFrame, side: str) -> DataFrame:
    """Nodes of open buckets dealt over cells of CELL_NODES times as many nodes: x by rows, y by columns.

    Each x meets each y of its bucket in just one cell.
    """
    blocks = F.ceil(F.col("members") / CELL_NODES).cast("int")
    own, every = F.pmod(F.xxhash64("node"), blocks).cast("int"), F.explode(F.sequence(F.lit(0), blocks - 1))
    row, column = (own, every) if side == "x" else (every, own)
    return left.select("*", row.alias("cell_row"), column.alias("cell_column"))


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80, sketch: SetSketch | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id and kept, a row for each row of ``docs`` (doc_id, text).

    Documents are linked where 100 times their shingles in common are at least ``percent`` times
    those in either. component_id is the smallest doc_id that links lead to; kept says that it is the
    row's own. Texts without words have no shingles and no links. Rows that share a doc_id are one
    document with the links of each. Rows with a null doc_id have no component and are kept. An empty
    table gives no rows; other columns are not looked at.
    """
    sketch = sketch or SetSketch()
    found, own = written(sketches(docs, shingle_words, sketch), "sketches"), _own(docs)
    with_id = found.where("doc_id is not null")
    several = with_id.groupBy("doc_id").agg(F.min("words_key").alias("lo"), F.max("words_key").alias("hi")).where("lo < hi").select("doc_id")
    several = written(several, "ids-of-several-texts")
    if several.isEmpty():
        out = _grouped(found, own, shingle_words, percent, sketch)
        return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    # each text of such a document is grouped under a name of its own; then the groups of a document become one
    names = _names(with_id.join(several, "doc_id", "left_semi").select("doc_id", "words_key", "t").distinct(), found)
    named = lambda rows: rows.join(names.select("doc_id", "t", "name"), ["doc_id", "t"], "left").withColumn("doc_id", F.coalesce("name", "doc_id")).drop("name", "t")
    parts = _grouped(named(found), named(own.withColumn("t", F.xxhash64("text"))), shingle_words, percent, sketch)
    true = names.groupBy(F.col("name").alias("doc_id")).agg(F.any_value("doc_id").alias("true_id"))
    parts = written(parts.join(true, "doc_id", "left").select(F.coalesce("true_id", "doc_id").alias("doc_id"), "n_shingles", F.col("component_id").alias("part"), F.col("true_id").isNotNull().alias("several")), "parts")
    first = parts.where("several").groupBy("doc_id").agg(F.min("part").alias("first"))
    joined = components(parts.where("several").join(first, "doc_id").select(F.col("first").alias("a"), F.col("part").alias("b")))
    parts = parts.join(joined.select(F.col("node").alias("part"), "root"), "part", "left").withColumn("root", F.coalesce("root", "part"))
    touched = parts.where("several").select("root").distinct()
    least = parts.join(touched, "root", "left_semi").groupBy("root").agg(F.min("doc_id").alias("least"))
    out = parts.join(least, "root", "left").select("doc_id", "n_shingles", F.coalesce("least", "root").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _names(texts: DataFrame, found: DataFrame) -> DataFrame:
    """``texts`` (doc_id, words_key, t) with a name for each doc_id and words_key, unlike all ids of ``found`` and other names."""
    salt = 0
    while True:
        names = written(texts.withColumn("name", F.xxhash64(F.lit(salt), "doc_id", "words_key")), "names")
        taken = names.join(found.select(F.col("doc_id").alias("name")), "name", "left_semi")
        twice = names.select("doc_id", "words_key", "name").distinct().groupBy("name").count().where("count > 1")
        if taken.isEmpty() and twice.isEmpty():
            return names
        salt += 1


def _grouped(found: DataFrame, docs: DataFrame, shingle_words: int, percent: int, sketch: SetSketch) -> DataFrame:
    """doc_id, n_shingles and component_id from the sketches and texts of documents with one sequence of words each."""
    nodes = found.where("n > 0 and doc_id is not null").groupBy("words_key").agg(F.min("doc_id").alias("node"), F.any_value("n").alias("n"), F.any_value("registers").alias("registers"))
    nodes = written(nodes, "sketch-nodes")

    bands = _bands(nodes, sketch)
    shared = bands.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count("*").alias("members")).where("lo < hi").select("key", "members")
    shared = written(shared, "shared-bands")
    members = written(join_counted(bands, shared.select("key"), "key", shared), "band-members")
    sets = written(shingle_sets(only_ids(docs, "doc_id", members.select("node"), keep=True), shingle_words), "shingle-sets")

    # What a node has alone is in no intersection: it bounds what the node can reach, and tells hubs from fringes.
    alone = sets.select("doc_id", F.explode("shingles").alias("s")).groupBy("s").agg(F.min("doc_id").alias("node"), F.max("doc_id").alias("hi")).where("node = hi")
    sizes = sets.groupBy(F.col("doc_id").alias("node")).agg(F.max(F.size("shingles")).alias("size_"))
    alone = sizes.join(alone.groupBy("node").agg(F.count("*").alias("alone")), "node", "left").select("node", F.col("size_").alias("n"), F.coalesce("alone", F.lit(0)).alias("alone"))
    members = written(members.join(alone.where(100 * (F.col("n") - F.col("alone")) >= percent * F.col("n")), "node"), "linkable-members")

    central = F.struct((F.col("alone") / F.col("n")).alias("share"), F.xxhash64("key", "node").alias("h"), "node")
    hubs = members.groupBy("key").agg(F.min(central).node.alias("hub"), F.count("*").alias("size")).where("size > 1")
    hubs = written(hubs, "band-hubs")
    starred = written(join_counted(members, hubs, "key", hubs.select("key", "size")).where("node != hub").select("key", "node", "n", "alone", "hub", "size"), "starred")
    by_hub = starred.select("node", "hub").distinct()
    likely = _likely(by_hub.select(F.col("node").alias("a"), F.col("hub").alias("b")), nodes, sketch, percent)
    compared = written(_against_hub(likely.select(F.col("a").alias("node"), F.col("b").alias("hub")), sets), "hub-pairs")
    links = compared.where(_reaches(F.col("i"), F.col("na"), F.col("nb"), percent)).select(F.col("node").alias("a"), F.col("hub").alias("b"))
    roots = written(components(links), "hub-roots")

    placed = starred.where("size > 2").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    placed = written(placed, "placed")
    open_keys = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("members")).where("lo < hi").select("key", "members")
    hub_facts = compared.select("node", "hub", "i", "lacks", "s0", "s1", "nb")
    open_keys = written(open_keys, "open-keys")
    left = written(join_counted(placed, open_keys, "key", open_keys).join(hub_facts, ["node", "hub"], "left"), "open-buckets")
    facts = ["node", "root", "n", "alone", "i", "lacks", "s0", "s1"]
    x, y = (_dealt(left, c).select("key", *[F.col(k).alias(f"{k}_{c}") for k in CELL], F.col("nb").alias(f"hub_{c}"), *[F.col(k).alias(f"{k}_{c}") for k in facts]) for c in "xy")
    of_x, of_y = ({k: F.col(f"{k}_{c}") for k in facts} for c in "xy")
    bounds = [F.least(of_x["n"] - of_x["alone"], of_y["n"] - of_y["alone"]), _most_common(F.col("hub_x"), of_x, of_y)]
    can = [F.coalesce(_reaches(common, of_x["n"], of_y["n"], percent), F.lit(True)) for common in bounds]
    in_cell = F.col("key") == F.col("key_y")
    for c in CELL:
        in_cell &= F.col(f"{c}_x") == F.col(f"{c}_y")
    rest = x.join(y.withColumnRenamed("key", "key_y"), in_cell & (of_x["root"] != of_y["root"]) & (of_x["node"] < of_y["node"]) & can[0] & can[1])
    rest = rest.select(of_x["node"].alias("a"), of_y["node"].alias("b")).distinct()
    more = written(_linked(_likely(rest, nodes, sketch, percent), sets, percent), "other-links")
    if not more.isEmpty():
        forest = roots.where("node != root").select(F.col("root").alias("a"), F.col("node").alias("b"))
        roots = written(components(forest.union(more)), "all-roots")

    of_words = nodes.join(roots, "node", "left").select("words_key", F.coalesce("root", "node").alias("root"))
    linkable = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    slim = found.select("doc_id", "n", "words_key")
    in_nodes = join_counted(slim.where(linkable), of_words, "words_key", _count(slim.where(linkable), "words_key"))
    joined = in_nodes.unionByName(slim.where(~linkable).withColumn("root", F.col("doc_id")))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.col("root").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that stay when one document of each component does: its smallest doc_id's."""
    return only_ids(docs, "doc_id", near_duplicates(docs, **how).where("not kept").select("doc_id"), keep=False)
