"""Totals of tokens by source, language and tokenizer version, kept up to date by signed changes.

A batch of changes is reduced to one signed row per key and appended under a name of its attempt;
totals are the sum over the batches that were committed. A batch counts once a commit record of one
of its attempts is there: readers take one record per batch and the delta of that attempt alone. So
a batch that is committed again, or was cut off anywhere before or within its record, changes
nothing, and can be committed anew.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["source", "lang", "tokenizer_version"]
DELTA = "source string, lang string, tokenizer_version string, d_docs bigint, d_tokens bigint, attempt string"
COMMIT = "batch_id string, attempt string, covers array<string>"


def signed(changes: DataFrame) -> tuple[Column, Column]:
    """Documents and tokens that a change adds: an insert adds, a delete takes off, a revision adds the difference."""
    new, old = F.coalesce("n_tokens", F.lit(0)), F.coalesce("old_n_tokens", F.lit(0))
    docs = F.when(F.col("change") == "insert", 1).when(F.col("change") == "delete", -1).otherwise(0)
    return docs, F.when(F.col("change") == "insert", new).when(F.col("change") == "delete", -old).otherwise(new - old)


class TokenRollup:
    """A rollup in a folder that all executors share.

    Changes have the columns change ('insert', 'delete' or 'revise'), source, lang,
    tokenizer_version, n_tokens (of inserts and revisions) and old_n_tokens (of deletes and
    revisions). A document that moves to another key is a delete and an insert. Null counts are 0,
    null keys are a key of their own, further columns are not looked at, and an empty batch is
    committed like any other. Repeated rows of a batch are repeated changes. Any other change, and
    a batch_id that is null or empty, is refused before anything is written.

    Writers may commit at once, also the same batch: of its attempts, all of the same changes, the
    one with the smallest name counts. Only one may call ``compact`` at a time.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        for name, schema in (("commits", COMMIT), ("deltas", DELTA)):  # so that both can be read from the start
            spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{self.path}/{name}/none")

    def commits(self) -> DataFrame:
        """batch_id, attempt and covers (the batches that a summary has summed up), a row per batch."""
        records = self.spark.read.schema(COMMIT).option("recursiveFileLookup", "true").parquet(f"{self.path}/commits")
        return records.groupBy("batch_id").agg(F.min(F.struct("attempt", "covers")).alias("r")).select("batch_id", "r.*")

    def _is_committed(self, batch_id: str) -> bool:
        if not batch_id:
            raise ValueError("a batch needs an id")
        return not self.commits().where(F.col("batch_id") == batch_id).isEmpty()

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Add a batch; False, with nothing changed, if ``batch_id`` was committed before."""
        if self._is_committed(batch_id):
            return False
        docs, tokens = signed(changes)
        known = F.coalesce(F.col("change").isin("insert", "delete", "revise"), F.lit(False))
        checked = F.when(known, docs).otherwise(F.raise_error(F.lit("a change is insert, delete or revise")).cast("int"))
        delta = changes.groupBy(*KEYS).agg(F.sum(checked.cast("bigint")).alias("d_docs"), F.sum(tokens.cast("bigint")).alias("d_tokens"))
        self._append(batch_id, delta, [])
        return True

    def _append(self, batch_id: str, delta: DataFrame, covers: list[str]) -> None:
        attempt = uuid.uuid4().hex
        self._write_delta(attempt, delta)
        self._write_record(batch_id, attempt, covers)

    def _write_delta(self, attempt: str, delta: DataFrame) -> None:
        delta.select(*KEYS, "d_docs", "d_tokens", F.lit(attempt).alias("attempt")).write.parquet(f"{self.path}/deltas/{attempt}")

    def _write_record(self, batch_id: str, attempt: str, covers: list[str]) -> None:
        """One row in one file, which the sink's commit makes visible as a whole."""
        record = self.spark.createDataFrame([(batch_id, attempt, covers)], COMMIT).coalesce(1)
        record.write.parquet(f"{self.path}/commits/{attempt}")

    def _live(self) -> list[tuple[str, str]]:
        """Batches and attempts that count and that no summary covers: one for each batch since the last summary."""
        commits = self.commits()
        covered = commits.select(F.explode("covers").alias("batch_id"))
        return [(r[0], r[1]) for r in commits.join(covered, "batch_id", "left_anti").select("batch_id", "attempt").collect()]

    def _summed(self, attempts: list[str]) -> DataFrame:
        """The deltas of some attempts, added up; those of others are not read."""
        paths = [f"{self.path}/deltas/{a}" for a in attempts] or [f"{self.path}/deltas/none"]
        deltas = self.spark.read.schema(DELTA).parquet(*paths)
        return deltas.groupBy(*KEYS).agg(F.sum("d_docs").alias("d_docs"), F.sum("d_tokens").alias("d_tokens"))

    def totals(self) -> DataFrame:
        """source, lang, tokenizer_version, n_docs, n_tokens; keys without documents or tokens are left out."""
        summed = self._summed([attempt for _, attempt in self._live()]).withColumnsRenamed({"d_docs": "n_docs", "d_tokens": "n_tokens"})
        return summed.where("n_docs != 0 or n_tokens != 0")

    def compact(self, batch_id: str) -> bool:
        """Sum up all batches so far in one, so that totals read less; totals stay as they are."""
        if self._is_committed(batch_id):
            return False
        live = self._live()
        self._append(batch_id, self._summed([attempt for _, attempt in live]), [batch for batch, _ in live])
        return True


    def vacuum(self) -> int:
        """Delete the deltas that count and that a summary covers, and return how many went; commit records stay.

        No reader may still be at work on totals from before the summary.
        """
        commits = self.commits()
        covered = commits.join(commits.select(F.explode("covers").alias("batch_id")).distinct(), "batch_id", "left_semi")
        jvm, gone = self.spark._jvm, 0
        for r in covered.select("attempt").distinct().collect():
            folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/deltas/{r['attempt']}")
            gone += bool(folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True))
        return gone


def count_columns(text: Column) -> dict[str, Column]:
    """Token counts of a text that Spark computes itself, by tokenizer version."""
    from trajix.llm.sqltext import WORD

    return {"words-1": F.regexp_count(text, F.lit(WORD)).cast("bigint"), "utf8-bytes-1": F.octet_length(text).cast("bigint")}


def with_bpe_counts(rows: DataFrame, tokenizer: str, texts: list[str]) -> DataFrame:
    """``rows`` with token counts by a vocabulary file in place of the string columns ``texts``; a null text has 0."""
    from collections.abc import Iterator

    import numpy as np
    import pyarrow as pa

    from trajix.llm.bpe_ids import RunBpe, steps, tidy

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = RunBpe.of(tokenizer)
        for batch in batches:
            columns = {c: batch[c] for c in batch.schema.names}
            for c in texts:
                sizes = [np.diff(bpe.encode(part)[1]) for _, part in steps(batch[c])]
                columns[c] = pa.array(np.concatenate([np.zeros(0, np.int64), *sizes]))
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return rows.mapInArrow(tidy(count), ", ".join(f"`{c}` {'bigint' if c in texts else t}" for c, t in rows.dtypes))


def bpe_counts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``docs`` (doc_id, source, lang, text) with n_tokens by a vocabulary file in place of the text; a null text has 0."""
    chosen = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), *[F.col(c).cast("string").alias(c) for c in ("source", "lang")], F.col("text").cast("string").alias("n_tokens"))
    return with_bpe_counts(chosen, tokenizer, ["n_tokens"])
