"""Nearest neighbours by multi-index hashing of learned binary codes.

Rotations learned by iterative quantisation on a bounded sample turn a vector into signs, and the
signs into a code of substrings of eight bits. An index shard keeps one table per substring, from
its 256 values to the codes that have them. By the pigeonhole principle a code within Hamming radius
r of a query is within radius r // m or less in one of the m substrings, so probing the values near
the query's own in each table meets every code within the radius. Those are reranked by Euclidean
distance on the original vectors. Equal vectors are one entry with its smallest ids.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trajix.llm.scratch import written
from trajix.llm.sqltext import hash_128

POPCOUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)
NEAR = np.argsort(POPCOUNT, kind="stable").astype(np.uint8)  # values by distance from 0
WITHIN = np.searchsorted(np.sort(POPCOUNT), np.arange(10), "left")  # how many have a smaller distance


@dataclass(frozen=True)
class Coder:
    """Means, rotations and the radius that met ``recall`` of the sample's own neighbours."""

    mean: np.ndarray
    rotation: np.ndarray
    radius: int

    def codes(self, x: np.ndarray) -> np.ndarray:
        """A row of bytes, one per substring, for each vector."""
        return np.packbits((x - self.mean) @ self.rotation > 0, axis=1)


def learn(sample: np.ndarray, rotations: int = 2, rounds: int = 30, recall: float = 0.97, neighbours: int = 10, seed: int = 3) -> Coder:
    """Iterative quantisation from ``rotations`` random starts over all dimensions, a multiple of eight bits in all.

    The radius is the smallest within which the codes of ``recall`` of the sample's nearest
    neighbours lie; in the whole table the nearest are nearer still.
    """
    rng, dim = np.random.default_rng(seed), sample.shape[1]
    mean = sample.mean(0)
    x = sample - mean
    parts = []
    for _ in range(rotations):
        r = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
        for _ in range(rounds):
            u, _, vt = np.linalg.svd(np.where(x @ r > 0, 1.0, -1.0).T @ x)
            r = (u @ vt).T
        parts.append(r)
    rotation = np.concatenate(parts, axis=1)
    rotation = rotation[:, : max(8, rotation.shape[1] // 8 * 8)]
    if rotation.shape[1] % 8:
        rotation = np.concatenate([rotation] * 8, axis=1)
    coder = Coder(mean, rotation, 0)
    asked = x[rng.permutation(len(x))[:200]]
    d = ((asked[:, None] - x[None]) ** 2).sum(2) if len(x) * len(asked) * dim < 5e7 else (asked**2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * asked @ x.T
    order = np.argsort(d, axis=1)[:, 1 : neighbours + 1]
    own, codes = coder.codes(asked + mean), coder.codes(sample)
    far = POPCOUNT[own[:, None] ^ codes[order]].sum(2, dtype=np.int64)
    return Coder(mean, rotation, int(np.quantile(far, recall)) if far.size else rotation.shape[1])


class Shard:
    """One table per substring over some codes."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.tables = []
        for j in range(codes.shape[1]):
            order = np.argsort(codes[:, j], kind="stable")
            self.tables.append((order, np.searchsorted(codes[order, j], np.arange(257))))

    def within(self, query: np.ndarray, radius: int) -> np.ndarray:
        """Every code within the radius of the query's: probes at r // m in the first tables, one less in the rest."""
        m = len(query)
        deep, more = divmod(radius, m)
        met = np.zeros(len(self.codes), bool)
        for j, (order, first) in enumerate(self.tables):
            reach = min(8, deep if j <= more else deep - 1)
            if reach >= 0:
                for value in (query[j] ^ NEAR[: WITHIN[reach + 1]]).tolist():
                    met[order[first[value] : first[value + 1]]] = True
        found = np.flatnonzero(met)
        return found[POPCOUNT[self.codes[found] ^ query].sum(1, dtype=np.int64) <= radius]


def _usable(rows: DataFrame, dim: int | None) -> tuple[DataFrame, int | None]:
    """vec_id and v, an array of doubles, of rows whose vector takes part."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("v")).where(
        F.col("vec_id").isNotNull() & v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0)
    )
    if dim is None:
        top = good.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
        dim = top["dim"] if top else None
    return (good.where(F.size("v") == dim) if dim else good), dim


def nearest_neighbours(
    rows: DataFrame,
    queries: DataFrame,
    k: int = 10,
    dim: int | None = None,
    sample_rows: int = 4096,
    recall: float = 0.97,
    rotations: int = 2,
    shard_rows: int = 8192,
    block_queries: int = 4096,
    seed: int = 3,
) -> DataFrame:
    """query_id, rank (from 1), vec_id and score (Euclidean distance in doubles), up to ``k`` rows for each query.

    ``rows`` and ``queries`` have vec_id and embedding; a query's own vec_id is no candidate.
    Equal scores go to the smaller vec_id. Vectors that are null, zero, or hold nulls or non-finite
    numbers take no part, nor do rows without a vec_id or of another length than ``dim`` (the most
    common one if not given). Rows that repeat a vec_id with the same vector count once. Empty
    tables give no rows; other columns are not looked at.

    The codes are learned on at most ``sample_rows`` vectors, the first by a seeded hash; every
    vector is indexed. Shards hold at most about ``shard_rows`` distinct vectors and meet queries in
    blocks. A shard with fewer than k + 1 codes in the radius widens it until it has as many.
    """
    good, dim = _usable(rows, dim)
    if dim is None:
        return rows.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    h1, h2 = hash_128(F.col("v"))
    keyed = written(good.withColumns({"h1": h1, "h2": h2}), "vectors")
    first_ids = Window.partitionBy("h1", "h2").orderBy("vec_id")
    few = keyed.groupBy("h1", "h2", "vec_id").agg(F.any_value("v").alias("v")).withColumn("n", F.row_number().over(first_ids)).where(F.col("n") <= k + 1)
    entries = written(few.groupBy("h1", "h2").agg(F.any_value("v").alias("v"), F.sort_array(F.collect_list("vec_id")).alias("ids")), "vector-entries")
    asked = written(_usable(queries, dim)[0].withColumns({"h1": h1, "h2": h2}), "query-vectors")
    asked_entries = written(asked.groupBy("h1", "h2").agg(F.any_value("v").alias("v")), "query-entries")
    sample = entries.orderBy(F.xxhash64(F.lit(seed), "h1", "h2")).limit(sample_rows).select("v").collect()
    if not sample:
        return rows.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    coder = learn(np.array([r["v"] for r in sample]), rotations, recall=recall, neighbours=k, seed=seed)
    shards = max(1, -(-entries.count() // shard_rows))
    blocks = max(1, -(-asked_entries.count() // block_queries))

    def search(shard: pa.Table, block: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        if shard.num_rows and block.num_rows:
            x, q = (np.stack(t["v"].combine_chunks().flatten().to_numpy().reshape(-1, dim)) for t in (shard, block))
            ids, at = shard["ids"].to_pylist(), Shard(coder.codes(x))
            most = at.codes.shape[1] * 8
            for i, code in enumerate(coder.codes(q)):
                radius = coder.radius
                found = at.within(code, radius)
                while len(found) < min(k + 1, len(x)):
                    radius = min(most, radius + 4)
                    found = at.within(code, radius)
                score = np.sqrt(((x[found] - q[i]) ** 2).sum(1))
                smallest = np.array([ids[j][0] for j in found])
                for j in np.lexsort((smallest, score))[: k + 1]:
                    for column, value in zip(out, (block["h1"][i].as_py(), block["h2"][i].as_py(), float(score[j]), ids[found[j]])):
                        column.append(value)
        types = pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.int64())
        return pa.table([pa.array(c, t) for c, t in zip(out, types)], names=["q1", "q2", "score", "ids"])

    place = F.pmod(F.xxhash64("h1", "h2"), F.lit(shards)), F.pmod(F.xxhash64("h1", "h2"), F.lit(blocks))
    index = entries.select("v", "ids", place[0].alias("shard"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))).alias("block"))
    probes = asked_entries.select("h1", "h2", "v", place[1].alias("block"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(shards - 1).cast("bigint"))).alias("shard"))
    met = index.groupBy("shard", "block").cogroup(probes.groupBy("shard", "block")).applyInArrow(search, "q1 bigint, q2 bigint, score double, ids array<bigint>")
    by_score = Window.partitionBy("q1", "q2").orderBy("score", "vec_id")
    best = met.select("q1", "q2", "score", F.explode("ids").alias("vec_id")).withColumn("n", F.row_number().over(by_score)).where(F.col("n") <= k + 1)
    ids = asked.select(F.col("vec_id").alias("query_id"), "h1", "h2").distinct()
    own = ids.join(best, (F.col("h1") == F.col("q1")) & (F.col("h2") == F.col("q2"))).where("vec_id != query_id")
    ranked = own.groupBy("query_id", "vec_id").agg(F.min("score").alias("score")).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
