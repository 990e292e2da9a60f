"""Removal of lines that several documents share, with Spark's own functions only.

Lines are exploded to (document, position, hash of the normalised line). One aggregate finds the
hashes over the threshold and the smallest doc_id that holds each; a join gives the positions that
each document loses; the text is put together again from the positions that stay. Only hashes and
positions move in the first two steps, and hot lines combine before they move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajix.llm.scratch import written
from trajix.llm.sqltext import ascii_lower, hash_128, let, strip


def line_key(line: Column) -> Column:
    """A line without blanks at both ends, A-Z in lower case."""
    return ascii_lower(strip(line))


def repeated_keys(lines: DataFrame, min_docs: int) -> DataFrame:
    """h1, h2, first: hashes that at least ``min_docs`` documents hold, and the smallest doc_id of each."""
    if min_docs == 2:  # two documents are there just where the smallest and the largest id differ
        seen = lines.groupBy("h1", "h2").agg(F.min("d").alias("first"), F.max("d").alias("last"))
        return seen.where("first < last").drop("last")
    seen = lines.select("h1", "h2", "d").distinct().groupBy("h1", "h2").agg(F.min("d").alias("first"), F.count("d").alias("n"))
    return seen.where(F.col("n") >= min_docs).drop("n")


def dedup_lines(docs: DataFrame, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """Drop lines whose key has ``min_chars`` code points or more and is found in ``min_docs`` documents
    or more, except in the smallest doc_id that holds it.

    Returns the columns of ``docs`` with the text that stays, and n_lines (before dropping) and
    n_dropped, which replace columns of those names. Null and empty texts are one empty line, and a
    null text comes back empty. Rows without a doc_id keep all lines and count for none. Rows that
    share a doc_id are one document; each keeps its own text. An empty table gives no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.col("doc_id").alias("d"), F.xxhash64(text).alias("t"), F.split(text, "\n").alias("lines")).where("d is not null")
    lines = own.select("d", "t", F.posexplode("lines").alias("pos", "line")).select("d", "t", "pos", line_key(F.col("line")).alias("key"))
    h1, h2 = hash_128(F.col("key"))
    lines = lines.where(F.char_length("key") >= min_chars).select("d", "t", "pos", h1.alias("h1"), h2.alias("h2"))
    shared = written(repeated_keys(lines, min_docs), "shared-lines")  # as a table of its own, the join can split a hot line
    lost = (
        lines.join(shared, ["h1", "h2"])
        .where("d != first")
        .groupBy("d", "t")
        .agg(F.collect_set("pos").alias("lost"))
        .select(F.col("d").alias("__d"), F.col("t").alias("__t"), F.col("lost").alias("__lost"))
    )
    others = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    joined = docs.select(*[F.col(f"`{c}`") for c in others]).join(lost, (F.col("doc_id") == F.col("__d")) & (F.xxhash64(text) == F.col("__t")), "left")
    stays = let(
        F.struct(F.split(text, "\n").alias("a"), F.col("__lost").alias("x")),
        lambda s: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(s.a) - 1), s.x), lambda i: s.a[i]), "\n"),
    )
    n_lines = F.size(F.split(text, "\n"))
    return joined.select(
        *[F.when(F.col("__lost").isNull(), text).otherwise(stays).alias("text") if c == "text" else F.col(f"`{c}`") for c in others],
        n_lines.cast("bigint").alias("n_lines"),
        F.coalesce(F.size("__lost"), F.lit(0)).cast("bigint").alias("n_dropped"),
    )
