"""Clean a corpus and pack it: a chain of five stages, each on all that the stage before it kept.

Each stage takes (spark, docs, sf_dir) and returns the columns of ``documents``, but for the last,
which returns the pieces of packed sequences. ``run`` writes each stage's result as Parquet to the
shared folder and reads it again as the next one's input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajix.llm import byte_net, quality_rules
from trajix.llm.line_dedup import dedup_lines
from trajix.llm.near_dedup import drop_near_duplicates
from trajix.llm.packing import pack_documents
from trajix.llm.scratch import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what the byte-level network, trained on labelled documents of the input, scores 0.5 or more."""
    return byte_net.keep_documents(docs.select(COLUMNS), byte_net.train(docs, _labels(spark, sf_dir)))


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what the base rules and a decision list learned on the input's labelled documents keep."""
    return quality_rules.keep_documents(docs.select(COLUMNS), _labels(spark, sf_dir))


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines that an earlier document holds; n_chars follows the text. Documents stay, also without text."""
    return dedup_lines(docs).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates (five words, similarity 0.8)."""
    return drop_near_duplicates(docs).select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack into sequences of 4096 tokens."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality_net", classify), ("quality_rules", apply_rules), ("line_dedup", drop_shared_lines), ("near_dedup", drop_copies), ("packing", pack)]

#: Learned models and tokens are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
