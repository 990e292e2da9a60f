"""Shards of nearly equal bytes by minimax contiguous partition, with Spark's own functions only.

Equal texts are one atomic group. Groups larger than an even share come first, each a shard of its own;
the others follow in the order of their texts' 64-bit hash. The smallest capacity for which the rest
fits into the shards left is found by binary search, each guess checked greedily, and the order is cut
where shards come nearest to even ones within that capacity.

The search needs prefix sums near possible cuts only. Spark sums the sizes by ranges of the hash, at
most some ten thousand of them; lookups that end inside a range of several groups leave an interval, so
that a guess is feasible, not feasible or open; and ranges that hold an open lookup are summed more
finely, until the capacity and all cuts are exact. The driver never has more than these sums.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trajix.llm.scratch import written

#: A row's own bytes beside its text's.
ROW_BYTES = 16
#: Ranges of the hash at the start: 2 to this power.
FIRST_BITS = 13
#: An open range is cut into 2 to this power at a time.
MORE_BITS = 4
#: Rows of a shard whose slots one task numbers, about.
CELL_ROWS = 1_000


def text_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("bigint")


def group_key(text: Column) -> Column:
    """Rows with the same key stay together: equal texts (null is empty), and unequal ones of equal 64-bit hash."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


@dataclass(frozen=True)
class ShardPlan:
    """The cuts of the order. ``alone``: keys of groups with a shard each; ``cuts``: the last key of each
    further shard but the last (shards that stay empty repeat the key before); ``capacity``: the largest shard's bytes."""

    shards: int
    alone: tuple[int, ...]
    cuts: tuple[int | None, ...]
    capacity: int

    def shard(self, key: Column) -> Column:
        """The shard of a row, from 0."""
        first = len(self.alone)
        passed = F.lit(first)
        if self.cuts:  # the number of cuts that the key is beyond; a cut of null lets every key pass
            passed = passed + F.size(F.filter(F.array(*[F.lit(c).cast("bigint") for c in self.cuts]), lambda c: c.isNull() | (key > c)))
        out = passed
        for i, k in enumerate(self.alone):
            out = F.when(key == F.lit(k), F.lit(i)).otherwise(out)
        return out.cast("int")


@dataclass(frozen=True)
class _Sums:
    """Prefix sums over ranges of the order: ends[i] is behind i ranges; whole[i] tells that range i can't be cut further."""

    ends: list[int]
    whole: list[bool]

    def floor(self, lo: int, hi: int) -> tuple[int, int]:
        """Between which bounds the last group's end at or before a point in [lo, hi] is."""
        a, b = (max(0, bisect_right(self.ends, t) - 1) for t in (lo, hi))
        return self.ends[a], hi if self.ends[b] < hi and b < len(self.whole) and not self.whole[b] else self.ends[b]

    def ceil(self, lo: int, hi: int) -> tuple[int, int]:
        """Between which bounds the first group's end at or after a point in [lo, hi] is."""
        a, b = (min(len(self.ends) - 1, bisect_left(self.ends, t)) for t in (lo, hi))
        return lo if self.ends[a] > lo and a and not self.whole[a - 1] else self.ends[a], self.ends[b]

    def open(self, lo: int, hi: int) -> set[int]:
        """Ranges that could be cut further with a point of [lo, hi] strictly inside."""
        first, last = max(0, bisect_right(self.ends, lo) - 1), min(len(self.whole), bisect_left(self.ends, hi))
        return {i for i in range(first, last) if not self.whole[i] and self.ends[i] < hi and self.ends[i + 1] > lo}


def _greedy(sums: _Sums, capacity: int, shards: int, best: bool) -> bool:
    """Whether ``shards`` of the capacity hold all, each filled as far as it goes; ``best`` takes open lookups at their upper bound."""
    at = 0
    for _ in range(shards):
        at = sums.floor(at + capacity, at + capacity)[best]
    return at >= sums.ends[-1]


def _smallest(sums: _Sums, shards: int, least: int, most: int, best: bool) -> int:
    """Binary search of the smallest feasible capacity of [least, most]; ``most`` is feasible."""
    while least < most:
        guess = (least + most) // 2
        if _greedy(sums, guess, shards, best):
            most = guess
        else:
            least = guess + 1
    return least


def _cut(sums: _Sums, shards: int, largest: int) -> tuple[int, list[int], set[int]]:
    """The smallest capacity, the ends of all shards but the last, and the ranges to be cut further before these are exact."""
    total = sums.ends[-1]
    least = max(largest, -(-total // shards))
    lo = _smallest(sums, shards, least, least + total, True)
    hi = _smallest(sums, shards, lo, least + total, False)
    todo: set[int] = set()
    left, right = [(0, 0)], [(total, total)]
    for _ in range(shards - 1):  # how far greedy filling comes from the left, and how far it must come so that the rest fits
        t = min(total, left[-1][0] + lo), min(total, left[-1][1] + hi)
        todo |= sums.open(*t)
        left.append(sums.floor(*t))
        t = max(0, right[-1][0] - hi), max(0, right[-1][1] - lo)
        todo |= sums.open(*t)
        right.append(sums.ceil(*t))
    if lo < hi or todo:
        return hi, [], todo
    cuts, at = [], 0
    for j in range(1, shards):
        even = at + (total - at) // (shards - j + 1)
        most = sums.floor(at + lo, at + lo)
        point = min(max(even, right[shards - j][0]), most[1])
        todo |= sums.open(at + lo, at + lo) | sums.open(point, point)
        before, after = sums.floor(point, point)[0], sums.ceil(point, point)[1]
        near = after if after <= most[0] and (before < right[shards - j][0] or after - even <= even - before) else before
        cuts.append(near)
        at = near
    return lo, cuts, todo


def plan_shards(groups: DataFrame, shards: int) -> ShardPlan:
    """The plan for ``groups`` (key bigint, bytes bigint; a row per key). An empty table gives a plan whose shards are all empty."""
    spark = groups.sparkSession
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    alone, left, largest = [], total, 0
    for r in groups.orderBy(F.desc("bytes"), "key").limit(shards).collect():
        if len(alone) == shards - 1 or r["bytes"] * (shards - len(alone)) <= left:
            largest = r["bytes"]
            break
        alone.append((r["key"], r["bytes"]))
        left -= r["bytes"]
    keys = tuple(k for k, _ in alone)
    rest = groups.where(~F.col("key").isin(list(keys))) if keys else groups
    n = shards - len(alone)

    def summed(of: DataFrame, bits: int) -> list[tuple]:
        """(first key, last key, bytes, groups, bits) of the ranges of the hash's first bits."""
        rows = of.groupBy(F.shiftright("key", 64 - bits)).agg(F.min("key").alias("a"), F.max("key").alias("b"), F.sum("bytes").alias("s"), F.count("*").alias("n"))
        return [(r["a"], r["b"], r["s"], r["n"], bits) for r in rows.select("a", "b", "s", "n").collect()]

    ranges = sorted(summed(rest, FIRST_BITS))
    while True:
        sums = _Sums(list(accumulate((r[2] for r in ranges), initial=0)), [r[3] == 1 for r in ranges])
        capacity, ends, todo = _cut(sums, n, largest)
        if not todo:
            break
        finer: list[tuple] = []
        for bits in {ranges[i][4] for i in todo}:
            own = spark.createDataFrame([(ranges[i][0] >> (64 - bits),) for i in todo if ranges[i][4] == bits], "range bigint")
            inside = rest.join(F.broadcast(own), F.shiftright("key", 64 - bits) == F.col("range"), "left_semi")
            finer += summed(inside, min(64, bits + MORE_BITS))
        ranges = sorted([r for i, r in enumerate(ranges) if i not in todo] + finer)
    cuts = []
    for end in ends:
        i = bisect_left(sums.ends, end)
        cuts.append(ranges[i - 1][1] if i else None)
    top = [b - a for a, b in zip([0, *ends], [*ends, sums.ends[-1]])] + [b for _, b in alone]
    return ShardPlan(shards, keys, tuple(cuts), max(top))


def measured(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` with its size, text_crc32 (of the text in UTF-8) and key; a null text has no bytes."""
    text = F.col("text").cast("string")
    own = [c for c in docs.columns if c not in ("size", "text_crc32", "key")]
    return docs.select(*[F.col(f"`{c}`") for c in own], text_size(text).alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), group_key(text).alias("key"))


def with_slots(placed: DataFrame) -> DataFrame:
    """Add slot, from 0 without gaps in each shard, to a written table with shard, doc_id and row (unique).

    Rows of a shard are dealt over cells of about CELL_ROWS rows, numbered there by doc_id, and cells start
    where those before end. Only the numbers of rows of cells are summed up over a shard.
    """
    most = placed.groupBy("shard").count().agg(F.max("count")).first()[0] or 0
    celled = placed.withColumn("__cell", F.pmod(F.xxhash64("row"), F.lit(max(1, -(-most // CELL_ROWS)))).cast("int"))
    in_order = Window.partitionBy("shard").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = celled.groupBy("shard", "__cell").agg(F.count("*").alias("n")).select("shard", "__cell", F.coalesce(F.sum("n").over(in_order), F.lit(0)).alias("__start"))
    own = F.row_number().over(Window.partitionBy("shard", "__cell").orderBy(F.col("doc_id").asc_nulls_first(), "row"))
    return celled.withColumn("slot", own - 1).join(starts, ["shard", "__cell"]).withColumn("slot", F.col("slot") + F.col("__start")).drop("__cell", "__start")


def shard_documents(docs: DataFrame, shards: int = 40) -> tuple[DataFrame, ShardPlan]:
    """doc_id, size, text_crc32, shard and slot of every row of ``docs`` (doc_id, text), and the plan.

    Sizes of shards are as equal as whole groups of equal texts allow: no contiguous partition of the
    order has a smaller largest shard. A null text is as an empty one and has no bytes; rows without a
    doc_id, and rows that share one, are placed each; an empty table gives no rows. Other columns are
    not looked at. With fewer groups than shards, or groups larger than a shard's even share, some
    shards are larger than others or stay empty.
    """
    slim = measured(docs.select("doc_id", "text")).select("doc_id", "size", "text_crc32", "key", F.monotonically_increasing_id().alias("row"))
    slim = written(slim, "measured-documents")
    groups = written(slim.groupBy("key").agg(F.sum("size").alias("bytes")), "text-groups")
    plan = plan_shards(groups, shards)
    placed = slim.withColumn("shard", plan.shard(F.col("key")))
    return with_slots(placed).select("doc_id", "size", "text_crc32", "shard", "slot"), plan


def write_shards(docs: DataFrame, plan: ShardPlan, path: str, file_rows: int = 1_000_000) -> None:
    """Write whole rows of ``docs`` as Parquet in a folder for each shard (shard=0 and so on).

    The plan alone tells a row's shard, so rows move once, and none needs to be looked up. Spark divides
    what is large of a shard over tasks, and puts small shards into one.
    """
    out = docs.drop("shard").withColumn("shard", plan.shard(group_key(F.col("text").cast("string"))))
    out.hint("rebalance", "shard").write.option("maxRecordsPerFile", file_rows).partitionBy("shard").parquet(path)


def read_shard(spark: SparkSession, path: str, shard: int) -> DataFrame:
    return spark.read.parquet(path).where(F.col("shard") == shard)
