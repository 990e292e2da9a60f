"""Tables and files that a job keeps outside its plan, in the folder that all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no shared folder and has one machine, as in tests.
LOCAL_DEFAULT = "file:///tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; where that is unset, a default on a local master and an error on any other."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = LOCAL_DEFAULT
    return f"{base.rstrip('/')}/trajix"


def new_path(spark: SparkSession, name: str) -> str:
    """A path of the shared folder that no other job uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Bytes of rows in one Arrow batch between Spark and Python while a table is written; a longer row is a batch of its own.
BATCH_BYTES = 4 << 20


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Bound Arrow batches by BATCH_BYTES where the session has no bound of its own.

    Spark counts rows up to its default of 64 MiB. The buffers for such batches, on both sides of
    each task, are outside the heap and stay with an executor after the task. No result depends on it.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if key in spark.conf.getAll:
        yield
        return
    spark.conf.set(key, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(key)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it from there.

    This cuts the lineage and survives lost executors, unlike a local checkpoint. The folder is
    left to the cluster's clean-up of ``spark.checkpoint.dir``.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Ids that are sent to every task: one column of eight bytes, so about ten megabytes at most.
MOST_SENT_IDS = 1_000_000


def only_ids(rows: DataFrame, column: str, ids: DataFrame, keep: bool) -> DataFrame:
    """``rows`` whose ``column`` is among the one column of ``ids``, or is not; nulls match nulls.

    Ids are written and counted first: up to MOST_SENT_IDS they are broadcast, so that wide rows
    stay where they are; beyond that both sides are shuffled.
    """
    from pyspark.sql import functions as F

    name = "__only_ids"
    ids = written(ids.toDF(name).distinct(), "ids")
    if ids.limit(MOST_SENT_IDS + 1).count() <= MOST_SENT_IDS:
        ids = F.broadcast(ids)
    return rows.join(ids, F.col(column).eqNullSafe(F.col(name)), "left_semi" if keep else "left_anti")


#: A key is hot from this many rows on, or from its share of all hot rows, so that there are at most MOST_HOT_KEYS hot keys.
LEAST_HOT_ROWS, MOST_HOT_KEYS = 1_000, 10_000


def join_counted(rows: DataFrame, facts: DataFrame, key: str, counts: DataFrame) -> DataFrame:
    """``rows`` joined with ``facts``, which has one row per key; ``counts`` has keys and how many of ``rows`` carry them.

    Rows of a hot key are dealt over as many parts as keep each to a bounded number of rows, and the
    key's facts are repeated for each part; the part goes by the bigint columns of ``rows``. The hot keys, MOST_HOT_KEYS at most, and their numbers
    of parts are broadcast. ``counts`` should be cheap to compute; it is reduced to hot keys first.
    """
    from pyspark.sql import functions as F

    n = F.col("__n")
    hot = written(counts.toDF(key, "__n").where(n > LEAST_HOT_ROWS), "hot-keys")
    total = hot.agg(F.sum(n)).first()[0]
    if total is None:
        return rows.join(facts, key)
    share = max(LEAST_HOT_ROWS, -(-total // MOST_HOT_KEYS))
    parts = F.broadcast(hot.where(n > share).select(key, F.ceil(n / share).cast("int").alias("__parts")))
    many = F.coalesce("__parts", F.lit(1))
    ids = [c for c, t in rows.dtypes if t == "bigint" and c != key]
    dealt = rows.join(parts, key, "left").withColumn("__part", F.pmod(F.xxhash64(*ids), many).cast("int")).drop("__parts")
    spread = facts.join(parts, key, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), many - 1))).drop("__parts")
    return dealt.join(spread, [key, "__part"]).drop("__part")
