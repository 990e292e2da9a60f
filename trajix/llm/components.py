"""Connected components of a distributed edge list by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajix.llm.scratch import join_counted, written


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to its smallest neighbour, or to itself if that is smaller."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count_if(F.col("v") > F.col("u")).alias("n")).where("n > 0")
    low = written(low, "smallest-neighbours")
    return join_counted(edges.select(F.col("a").alias("u"), F.col("b").alias("v")), low.drop("n"), "u", low.select("u", "n")).select(F.col("m").alias("a"), F.col("v").alias("b")).where("a != b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node links itself and its smaller neighbours to the smallest of them. Edges have a < b."""
    low = written(edges.groupBy("b").agg(F.min("a").alias("m"), F.count("*").alias("n")), "smallest-neighbours")
    # a node with one smaller neighbour is linked to it already
    across = join_counted(edges, low.where("n > 1").drop("n"), "b", low.select("b", "n")).select(F.col("m").alias("a"), F.col("a").alias("b")).where("a != b")
    return across.union(low.select(F.col("m").alias("a"), "b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and root, the smallest node of its component, for every node of the edges (a, b).

    Loops and repeated edges change nothing; rows with a null take no part. Each round is written
    to the shared folder; the driver sees a count and a checksum of a round only. Hubs with many
    edges are joined without moving these.
    """
    edges = edges.where("a is not null and b is not null and a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges, before = written(edges, "edges"), None
    while True:
        edges = written(_small_star(written(_large_star(edges), "large-stars")), "stars")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20)"))).first())
        if now == before:
            break
        before = now
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
