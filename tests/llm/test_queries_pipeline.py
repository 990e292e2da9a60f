"""The registered queries against SQL, and the pipeline stage by stage."""

import collections

import pytest
from pyspark.sql import functions as F

from trajix.llm import quality_rules
from trajix.llm.queries import MORE_QUERIES, ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, tables, duck, same, name):
    same((QUERIES | MORE_QUERIES)[name](spark, tables), duck, ORACLE_SQL[name])


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_pipeline(spark, tables):
    import corpus_pipeline
    from test_lines_rules_rollup import plain_dedup
    from test_near_search import plain_components
    from trajix.llm.scratch import written

    docs = spark.read.parquet(f"{tables}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{tables}/labels.parquet").collect()}
    rows = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    before = rows(docs)
    for name in ("quality_net", "quality_rules", "line_dedup", "near_dedup"):
        docs = written(stages[name](spark, docs, tables), "test-stage")
        assert docs.columns == corpus_pipeline.COLUMNS
        after = rows(docs)
        if name.startswith("quality"):
            assert all(after[d] == before[d] for d in after)
            lost = [d for d in before if d not in after and labels.get(d) == 1]
            assert len(lost) < 0.1 * sum(labels.get(d) == 1 for d in before)
        elif name == "line_dedup":
            assert after == dict(plain_dedup(list(before.items())))
            assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
        else:
            root, _ = plain_components(before.items(), 5, 80)
            assert after.keys() == {d for d in root if root[d] == d}
        before = after
    packed = written(stages["packing"](spark, docs, tables), "test-stage")
    assert {r["doc_id"] for r in packed.collect()} == before.keys()
    assert corpus_pipeline.ORACLE_SQL is None and corpus_pipeline.run(spark, tables).count() == packed.count()


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Rows without an id or of one id keep their own verdicts; empty tables and extra columns pass through all stages."""
    import corpus_pipeline

    tables = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{tables}/{t}.parquet") for t in ("documents", "labels"))
    sf = f"file://{tmp_path}/sf"
    labels.write.parquet(f"{sf}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    good = [r["text"] for r in docs.join(labels.where("quality = 1"), "doc_id").where("length(text) between 2000 and 4000").orderBy("doc_id").limit(3).collect()]
    odd = [(None, good[0]), (None, "short"), (None, None), (10**6, good[1]), (10**6, "word " * 300), (10**6 + 1, ""), (10**6 + 2, good[2]), (10**6 + 2, good[2])]
    more = spark.createDataFrame([(d, t, None, None, None, "x", 1) for d, t in odd], "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words string, score int")
    both = docs.withColumns({"n_words": F.lit("clash"), "score": F.lit(7)}).unionByName(more)
    for name in ("quality_net", "quality_rules"):
        out = stages[name](spark, both, sf)
        assert out.columns == corpus_pipeline.COLUMNS
        left = collections.Counter((r["doc_id"], r["text"]) for r in out.collect())
        assert left[None, good[0]] == left[10**6, good[1]] == 1 and left[10**6 + 2, good[2]] == 2, name
        assert name == "quality_net" or not left[None, "short"] + left[None, None] + left[10**6, "word " * 300] + left[10**6 + 1, ""]
        plain = stages[name](spark, docs, sf)
        assert {k: v for k, v in left.items() if k[0] is not None and k[0] < 10**6} == collections.Counter((r["doc_id"], r["text"]) for r in plain.collect())
    judged, _ = quality_rules.judge(docs, labels)
    assert {r["doc_id"] for r in judged.where("kept").collect()} == {r["doc_id"] for r in stages["quality_rules"](spark, docs, sf).collect()}
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, more.select(corpus_pipeline.COLUMNS), sf)
        assert name == "packing" or rows.columns == corpus_pipeline.COLUMNS
        if name in ("line_dedup", "packing"):
            assert len({(r["doc_id"], r["n_chars"] if name == "line_dedup" else r["ids_crc32"]) for r in rows.collect()}) >= 6
        assert stage(spark, docs.where("false"), sf).count() == 0
    kept = stages["near_dedup"](spark, more.select(corpus_pipeline.COLUMNS), sf).collect()
    assert collections.Counter(r["doc_id"] for r in kept) == {None: 3, 10**6: 2, 10**6 + 1: 1, 10**6 + 2: 2}
