"""Centroid clustering of integer vectors by Lloyd's rounds, filtered through ball trees.

Each task turns the vectors that it reads into blocks, each a metric tree: a node keeps its ball's
center and radius, the count and the integer sum of its vectors. The blocks are a table. In a round
each block is searched from its root with all centroids as candidates. By the triangle inequality a
centroid that is farther from the whole ball than another one drops out, and a ball with one candidate
left counts as a whole, by its count and sum. Else the search goes down to the leaves, where distances
are exact integers. Blocks give one row for each cluster; the driver sees the centroids alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajix.llm.bpe_ids import tidy
from trajix.llm.scratch import written

#: Relative slack of distances and radii in the pruning, far above their rounding.
SLACK = 1e-9
LONGEST = (1 << 63) - 1


def most_component(dim: int) -> int:
    """Components are held to this size, so that squared distances fit in a long: 2^27 for 64 of them."""
    return math.isqrt((1 << 62) // dim) // 2


@dataclass
class BallTree:
    """Vectors of a block in the order of the leaves, and nodes: lo and hi of its vectors, the children (0: a leaf)."""

    x: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    left: np.ndarray
    right: np.ndarray
    center: np.ndarray
    radius: np.ndarray
    total: np.ndarray

    @classmethod
    def build(cls, x: np.ndarray, leaf: int) -> tuple["BallTree", np.ndarray]:
        """The tree and the order of the rows of ``x`` in it. A ball is split between two far vectors of it."""
        order, nodes, todo = np.arange(len(x)), [], [(0, len(x), -1, 0)]
        while todo:
            lo, hi, parent, side = todo.pop()
            if parent >= 0:
                nodes[parent][2 + side] = len(nodes)
            own = x[order[lo:hi]]
            total = own.sum(0)
            center = total / (hi - lo)
            far = np.sqrt(((own - center) ** 2).sum(1))
            nodes.append([lo, hi, 0, 0, center, far.max() * (1 + SLACK), total])
            if hi - lo > leaf and far.max() > 0:
                a = own[far.argmax()].astype(float)
                from_a = ((own - a) ** 2).sum(1)
                b = own[from_a.argmax()].astype(float)
                near = from_a <= ((own - b) ** 2).sum(1)
                order[lo:hi] = np.concatenate([order[lo:hi][near], order[lo:hi][~near]])
                cut = lo + int(near.sum())
                if lo < cut < hi:
                    todo += [(lo, cut, len(nodes) - 1, 0), (cut, hi, len(nodes) - 1, 1)]
        columns = list(zip(*nodes))
        return cls(x[order], *(np.array(c, np.int64) for c in columns[:4]), np.array(columns[4]), np.array(columns[5]), np.array(columns[6], np.int64)), order

    def filtered(self, centroids: np.ndarray) -> Iterator[tuple[int, int, int | np.ndarray, np.ndarray | None]]:
        """(lo, hi, cluster, sum) of balls that go to one centroid whole, (lo, hi, clusters, None) of leaves."""
        todo = [(0, np.arange(len(centroids)))]
        while todo:
            node, near = todo.pop()
            lo, hi, radius = int(self.lo[node]), int(self.hi[node]), self.radius[node]
            d = np.sqrt(((centroids[near] - self.center[node]) ** 2).sum(1))
            if len(near) > 1:
                reach = (d.min() + 2 * radius) * (1 + SLACK) + SLACK * (1 + np.abs(self.center[node]).sum())
                near = near[d <= reach]
            if len(near) == 1:
                yield lo, hi, int(near[0]), self.total[node]
            elif self.left[node]:
                todo += [(int(self.left[node]), near), (int(self.right[node]), near)]
            else:
                yield lo, hi, near[distances(self.x[lo:hi], centroids[near]).argmin(1)], None

    def packed(self) -> list[bytes]:
        ints = np.stack([self.lo, self.hi, self.left, self.right])
        return [a.tobytes() for a in (self.x, ints, self.center, self.radius, self.total)]

    @classmethod
    def unpacked(cls, raw: list[bytes], dim: int) -> "BallTree":
        x, ints, center, radius, total = (np.frombuffer(b, t) for b, t in zip(raw, (np.int64, np.int64, float, float, np.int64)))
        return cls(x.reshape(-1, dim), *ints.reshape(4, -1), center.reshape(-1, dim), radius, total.reshape(-1, dim))


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer vectors, a row for each of ``x``."""
    largest = int(max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)))
    if x.shape[1] * largest**2 < 1 << 51:  # all sums are whole numbers that floating point holds
        a, b = x.astype(float), c.astype(float)
        return ((a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * (a @ b.T)).astype(np.int64)
    return np.stack([((x - row) ** 2).sum(1) for row in c], axis=1)


def integer_vectors(rows: DataFrame, dim: int, scale: int) -> DataFrame:
    """vec_id, v (the components floor(scale * x), held to ``most_component``) of the vectors that take part."""
    v, most = F.col("embedding").cast("array<double>"), float(most_component(dim))
    own = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("v")).where(F.col("v").isNotNull() & (F.size("v") == dim))
    own = own.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    held = lambda x: F.floor(F.greatest(F.lit(-most), F.least(F.lit(most), F.lit(float(scale)) * x))).cast("bigint")
    return own.select("vec_id", F.transform("v", held).alias("v"))


def tree_blocks(vectors: DataFrame, dim: int, block_rows: int, leaf: int) -> DataFrame:
    """ids, and the parts of a tree in bytes, for each ``block_rows`` vectors that a task reads."""

    def block(ids: list, parts: list) -> pa.RecordBatch:
        x = np.concatenate(parts)
        tree, order = BallTree.build(x, leaf)
        ids = pa.concat_arrays(ids).take(pa.array(order))
        return pa.RecordBatch.from_arrays([pa.array([ids.to_pylist()], pa.list_(pa.int64())), pa.array([tree.packed()], pa.list_(pa.binary()))], names=["ids", "tree"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, n = [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, block_rows):
                own = batch.slice(at, block_rows)
                if n and n + own.num_rows > block_rows:
                    yield block(ids, parts)
                    ids, parts, n = [], [], 0
                ids.append(own["vec_id"])
                parts.append(own["v"].flatten().to_numpy().astype(np.int64).reshape(-1, dim))
                n += own.num_rows
        if n:
            yield block(ids, parts)

    return vectors.mapInArrow(tidy(rows), "ids array<bigint>, tree array<binary>")


def _moved(blocks: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round: the floor of the exact mean of their vectors; those without any stay."""
    k, dim = centroids.shape

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch["tree"].to_pylist():
                tree, n, total = BallTree.unpacked(raw, dim), np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
                for lo, hi, cluster, whole in tree.filtered(centroids):
                    if whole is not None:
                        n[cluster] += hi - lo
                        total[cluster] += whole
                    else:
                        n += np.bincount(cluster, minlength=k)
                        np.add.at(total, cluster, tree.x[lo:hi])
                own = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(n[own]), pa.array(total[own].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "total"])

    made = blocks.select("tree").mapInArrow(tidy(rows), "cluster bigint, n bigint, total array<bigint>")
    exact = made.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("total")[i].cast("decimal(20,0)")).alias(f"t{i}") for i in range(dim)])
    out = centroids.copy()
    for r in exact.collect():  # a row for each centroid at most
        out[r["cluster"]] = [int(r[f"t{i}"]) // r["n"] for i in range(dim)]
    return out


@dataclass(frozen=True)
class Clusters:
    """The final centroids, and vec_id, cluster and distance of every vector that takes part."""

    centroids: np.ndarray
    assigned: DataFrame


def cluster_vectors(rows: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64, seed: int = 1, block_rows: int = 4096, leaf: int = 32) -> Clusters:
    """Lloyd's rounds on ``rows`` (vec_id, embedding).

    Vectors with ``dim`` components, none null or not finite, take part, as integers floor(scale * x),
    held to ``most_component`` (plus and minus 2^27). The first centroids are the ``k`` vectors with the smallest SHA-256 of
    ``seed:vec_id``, in that order; repeated rows each count, and of those that share a vec_id the
    smaller vector comes first. A row without a vec_id is assigned, but is no first centroid. With
    fewer than ``k`` vectors there are as many centroids; with none there are no rows. Ties go to the
    smaller number. Other columns are not looked at.
    """
    spark = rows.sparkSession
    vectors = integer_vectors(rows, dim, scale)
    start = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = vectors.where("vec_id is not null").select(start.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    if not first:
        return Clusters(np.zeros((0, dim), np.int64), spark.createDataFrame([], "vec_id bigint, cluster int, distance bigint"))
    blocks = written(tree_blocks(vectors, dim, block_rows, leaf), "ball-trees")
    centroids = np.array([r["v"] for r in first], np.int64)
    for _ in range(rounds):
        centroids = _moved(blocks, centroids)

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, raw in zip(batch["ids"], batch["tree"].to_pylist()):
                tree = BallTree.unpacked(raw, dim)
                cluster = np.zeros(len(tree.x), np.int32)
                for lo, hi, own, _ in tree.filtered(centroids):
                    cluster[lo:hi] = own
                d = ((tree.x - centroids[cluster]) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(cluster), pa.array(d)], names=["vec_id", "cluster", "distance"])

    assigned = blocks.mapInArrow(tidy(ends), "vec_id bigint, cluster int, distance bigint")
    return Clusters(centroids, assigned)


def with_inertia(clusters: Clusters) -> DataFrame:
    """The assigned vectors with cluster_inertia, inertia and centroid_sha256 (of the centroid's numbers joined by commas).

    Sums beyond a long are given as the largest long.
    """
    assigned = written(clusters.assigned, "assigned")
    sums = {r["cluster"]: int(r["s"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect()}
    held = lambda n: F.lit(min(n, LONGEST)).cast("bigint")
    if not sums:
        return assigned.select("*", *[F.lit(None).cast("bigint").alias(c) for c in ("cluster_inertia", "inertia")], F.lit(None).cast("string").alias("centroid_sha256"))
    names = {c: ",".join(map(str, clusters.centroids[c].tolist())) for c in sums}
    own = F.col("cluster")
    of = lambda values: F.element_at(F.create_map(*[x for c, v in values.items() for x in (F.lit(c), v)]), own)
    return assigned.select("*", of({c: held(s) for c, s in sums.items()}).alias("cluster_inertia"), held(sum(sums.values())).alias("inertia"), of({c: F.sha2(F.lit(n), 256) for c, n in names.items()}).alias("centroid_sha256"))
