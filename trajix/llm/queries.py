"""The registered queries of this subpackage, each an operator applied to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajix.llm import byte_net, line_dedup, quality_rules, token_rollup, warc
from trajix.llm.ball_clusters import cluster_vectors, with_inertia
from trajix.llm.filter_audit import audit_filters
from trajix.llm.multi_index import nearest_neighbours
from trajix.llm.near_dedup import near_duplicates
from trajix.llm.packing import pack_documents
from trajix.llm.scratch import new_path, written
from trajix.llm.sharding import shard_documents
from trajix.llm.sqltext import BLANK_RUN, hash_128, strip
from trajix.llm.token_files import write_and_index
from trajix.llm.unigram import round_trips

WORD_BPE = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents are inserted, their counts revised to those of the text with plain blanks, and
    exact copies of an earlier document deleted; two batches come in twice. Totals by source,
    language and tokenizer version (words, bytes and the tokens of a public vocabulary), after the
    batches were summed up."""
    return _rolled_up(spark, sf_dir, WORD_BPE)


def op1_token_rollup_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same changes with the two versions that Spark counts itself, and SQL can."""
    return _rolled_up(spark, sf_dir, None)


def _rolled_up(spark: SparkSession, sf_dir: str, tokenizer: str | None) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    plain = F.regexp_replace(strip(text), BLANK_RUN, " ")
    h1, h2 = hash_128(text)
    raw, new = token_rollup.count_columns(text), token_rollup.count_columns(plain)
    own = [F.struct(F.lit(v).alias("tokenizer_version"), raw[v].alias("n"), new[v].alias("m")) for v in raw]
    counted = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", h1.alias("h1"), h2.alias("h2"), F.array(*own).alias("own"), text.alias("n"), F.nullif(plain, text).alias("m"), (plain == text).alias("kept"))
    if tokenizer:
        counted = token_rollup.with_bpe_counts(counted, public_tokenizers.path(tokenizer), ["n", "m"])
        bpe = F.struct(F.lit(tokenizer.removesuffix(".json")).alias("tokenizer_version"), F.col("n"), F.when(F.col("kept"), F.col("n")).otherwise(F.col("m")).alias("m"))
        counted = counted.withColumn("own", F.array_append("own", bpe))
    counted = written(counted.select("doc_id", "source", "lang", "h1", "h2", F.explode("own").alias("x")).select("doc_id", "source", "lang", "h1", "h2", "x.*"), "token-counts")
    firsts = counted.groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    keys = ["source", "lang", "tokenizer_version"]
    null = F.lit(None).cast("bigint")
    batches = {
        "insert": counted.select(F.lit("insert").alias("change"), *keys, F.col("n").alias("n_tokens"), null.alias("old_n_tokens")),
        "revise": counted.where("n != m").select(F.lit("revise").alias("change"), *keys, F.col("m").alias("n_tokens"), F.col("n").alias("old_n_tokens")),
        "copies": counted.where("doc_id is not null").join(firsts, "doc_id", "left_anti").select(F.lit("delete").alias("change"), *keys, null.alias("n_tokens"), F.col("m").alias("old_n_tokens")),
    }
    rollup = token_rollup.TokenRollup(spark, new_path(spark, "token-rollup"))
    for name in ("insert", "revise", "revise", "copies", "insert"):
        rollup.commit(name, batches[name])
    rollup.compact("summary")
    return rollup.totals()


SQL_1 = r"""
WITH d AS (
  SELECT *, regexp_replace(trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '[\x20\x09-\x0D]+', ' ', 'g') AS p,
         row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id) AS k
  FROM documents
), n AS (
  SELECT source, lang, 'words-1' AS tokenizer_version, CAST(len(list_filter(string_split(p, ' '), lambda x: x <> '')) AS BIGINT) AS n FROM d WHERE k = 1
  UNION ALL
  SELECT source, lang, 'utf8-bytes-1', CAST(strlen(p) AS BIGINT) FROM d WHERE k = 1
)
SELECT source, lang, tokenizer_version, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens FROM n GROUP BY ALL
"""


def op2_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write_warc(table(spark, sf_dir, "pages"), path)
    found = warc.read_warc(spark, path, with_payload=False)
    fresh = F.when(F.col("reason").isNull(), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("gap in a fresh archive: "), F.col("reason"))).cast("boolean"))
    return found.where(fresh).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL_2 = """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), h AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS head FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN head <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN head <> page_id THEN head END AS refers_to
FROM h
"""


def op3_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return write_and_index(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE)).drop("part")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL_5 = """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), m AS (
  SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING min(doc_id) < max(doc_id)
), t AS (
  SELECT k.doc_id, pos, line, m.first IS NOT NULL AND m.first <> k.doc_id AS gone FROM k LEFT JOIN m ON k.key = m.key
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM t GROUP BY doc_id
"""


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdict, _ = quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return verdict.select("doc_id", *quality_rules.COUNTS, "base_failed", "kept")


def op6_quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics and base rules of op6_quality_rules without its learned verdict, which SQL can't express."""
    counts = quality_rules.text_counts(table(spark, sf_dir, "documents"))
    return counts.select("doc_id", *quality_rules.COUNTS, quality_rules.base_failed().alias("base_failed"))


SQL_6_COUNTS = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM t
), n AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols FROM w
), l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t
), d AS (
  SELECT doc_id, CAST(count(*) - count(DISTINCT line) AS BIGINT) AS n_dup_lines FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), g AS (
  SELECT doc_id, k, list_slice(words, k, k + 4) AS g FROM w, unnest(range(1, len(words) - 3)) AS r(k)
), r AS (
  SELECT doc_id, k FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1
), c AS (
  SELECT doc_id, CAST(sum(least(5, coalesce(next - k, 5))) AS BIGINT) AS n_repeat_words
  FROM (SELECT doc_id, k, lead(k) OVER (PARTITION BY doc_id ORDER BY k) AS next FROM r) GROUP BY doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
       n_words < 10 OR 100 * coalesce(n_repeat_words, 0) > 20 * n_words AS base_failed
FROM n LEFT JOIN d USING (doc_id) LEFT JOIN c USING (doc_id)
"""


def op7_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return nearest_neighbours(rows, rows.where("vec_id % 100 = 0"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle_words=3, percent=85)


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trips(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_quality_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return byte_net.score_documents(docs, byte_net.train(docs, table(spark, sf_dir, "labels")))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL_11 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), m AS (
  SELECT doc_id, part,
         CASE WHEN len(words) < 200 THEN 1 ELSE 0 END
         + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
         + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
         + CASE WHEN min(doc_id) OVER (PARTITION BY text) < doc_id THEN 16 ELSE 0 END AS mask
  FROM w
), l AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), c AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY part, mask
), f AS (
  SELECT substr('ABCDE', CAST(k AS INTEGER) + 1, 1) AS f, CAST(1 << k AS INTEGER) AS bit FROM range(5) AS r(k)
), p(filter_order, used, step, own, before) AS (
  SELECT f, bit, 1, bit, 0 FROM f
  UNION ALL
  SELECT filter_order || f, used + bit, step + 1, bit, used FROM p, f WHERE used & bit = 0
), o AS (
  SELECT whole.filter_order, s.step, s.own, s.before
  FROM p AS whole JOIN p AS s ON s.filter_order = substr(whole.filter_order, 1, s.step) WHERE whole.step = 5
), a AS (
  SELECT part, filter_order, step, own,
         sum(CASE WHEN mask & (before + own) = 0 THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN mask & own > 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN mask & own > 0 AND mask & before > 0 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN mask & own > 0 AND mask & before = 0 THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN mask & own > 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM c, o GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM a
"""


def op12_ball_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_inertia(cluster_vectors(table(spark, sf_dir, "embeddings")))


def _sql_12(rounds: int = 3) -> str:
    """Each round: the distances of all pairs, the nearest centroid, and the floor of the mean."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""d{r} AS (
  SELECT row, c, CAST(sum((x - y) * (x - y)) AS BIGINT) AS d FROM e JOIN c{r} USING (i) GROUP BY row, c
), a{r} AS (
  SELECT row, c, d FROM d{r} QUALIFY row_number() OVER (PARTITION BY row ORDER BY d, c) = 1
)""")
        if r < rounds:
            steps.append(f"""m{r} AS (
  SELECT c, i, (sum(CAST(x AS HUGEINT)) - ((sum(CAST(x AS HUGEINT)) % count(*)) + count(*)) % count(*)) // count(*) AS y FROM e JOIN a{r} USING (row) GROUP BY c, i
), c{r + 1} AS (
  SELECT c, i, CAST(coalesce(m{r}.y, c{r}.y) AS BIGINT) AS y FROM c{r} LEFT JOIN m{r} USING (c, i)
)""")
    return f"""
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), e AS (
  SELECT row, unnest(v) AS x, unnest(range(64)) AS i FROM v
), s AS (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS c, v FROM v WHERE vec_id IS NOT NULL ORDER BY sha256('1:' || vec_id), v LIMIT 16
), c0 AS (
  SELECT c, unnest(v) AS y, unnest(range(64)) AS i FROM s
), {", ".join(steps)}, h AS (
  SELECT c, sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY c
)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{rounds} JOIN h USING (c) JOIN v USING (row)
"""


def op13_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed, _ = shard_documents(table(spark, sf_dir, "documents"), shards=40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {f.__name__: f for f in (op1_token_rollup, op2_warc_salvage, op3_pack_documents, op4_token_files, op5_line_dedup, op6_quality_rules, op7_multi_index, op8_minhash_near_dedup, op9_sentencepiece, op10_quality_net, op11_filter_audit, op12_ball_clusters, op13_shards)}
#: Registered beside the thirteen: the parts of two queries that SQL can express.
MORE_QUERIES = {f.__name__: f for f in (op1_token_rollup_counts, op6_quality_counts)}
ORACLE_SQL: dict[str, str] = {"op1_token_rollup_counts": SQL_1, "op2_warc_salvage": SQL_2, "op5_line_dedup": SQL_5, "op6_quality_counts": SQL_6_COUNTS, "op11_filter_audit": SQL_11, "op12_ball_clusters": _sql_12()}
