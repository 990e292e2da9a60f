"""Totals of a vocabulary's tokens, from documents to the rollup."""

import collections
import re


def test_rollup_counts_a_vocabulary(spark, tables, duck, vocabulary):
    from tokenizers import Tokenizer

    import __spark_entry__
    from trajix.llm.queries import ORACLE_SQL

    got = {(r["source"], r["lang"], r["tokenizer_version"]): (r["n_docs"], r["n_tokens"]) for r in __spark_entry__.queries()["op1_token_rollup"](spark, tables).collect()}
    cur = duck.execute(ORACLE_SQL["op1_token_rollup_counts"])
    at = [[c[0] for c in cur.description].index(c) for c in ("source", "lang", "tokenizer_version", "n_docs", "n_tokens")]
    expected = {tuple(r[k] for k in at[:3]): tuple(r[k] for k in at[3:]) for r in cur.fetchall()}
    assert {k: v for k, v in got.items() if k[2] != "word_bpe_49k"} == expected
    first = {}
    for r in sorted(spark.read.parquet(f"{tables}/documents.parquet").collect(), key=lambda r: r["doc_id"]):
        first.setdefault(r["text"] or "", (r["source"], r["lang"]))
    tokenizer, totals = Tokenizer.from_file(vocabulary), collections.defaultdict(lambda: (0, 0))
    for text, key in first.items():
        n = len(tokenizer.encode(re.sub(r"[ \t-\r]+", " ", text.strip(" \t\n\v\f\r")), add_special_tokens=False).ids)
        totals[key] = (totals[key][0] + 1, totals[key][1] + n)
    assert {k[:2]: v for k, v in got.items() if k[2] == "word_bpe_49k"} == totals


def test_vacuum_leaves_totals(spark):
    """Deltas that a summary covers are deleted; totals, and batches that come in again, stay as they were."""
    import glob

    from trajix.llm.scratch import new_path
    from trajix.llm.token_rollup import TokenRollup

    path = new_path(spark, "vacuum")
    rollup = TokenRollup(spark, path)
    schema = "change string, source string, lang string, tokenizer_version string, n_tokens bigint, old_n_tokens bigint"
    batch = lambda n: spark.createDataFrame([("insert", "a", "en", "v", n, None), ("insert", None, None, "v", 2, None)], schema)
    for k in range(3):
        rollup.commit(f"b{k}", batch(k))
    shown = lambda: sorted(map(tuple, rollup.totals().collect()), key=repr)
    before = shown()
    assert rollup.vacuum() == 0 and shown() == before  # nothing is covered yet
    rollup.compact("s1")
    assert rollup.vacuum() == 3 and shown() == before and rollup.vacuum() == 0
    assert len(glob.glob(f"{path.removeprefix('file://')}/deltas/*")) == 2  # the summary and the empty one
    rollup.commit("b1", batch(1))
    assert shown() == before
    rollup.commit("b3", batch(5))
    rollup.compact("s2")
    after = shown()
    assert after != before and rollup.vacuum() == 2 and shown() == after
