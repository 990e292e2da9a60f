"""The native operators against plain Python."""

import collections
import re

import pytest

from trajix.llm import line_dedup, quality_rules, token_rollup
from trajix.llm.scratch import new_path

BLANK = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_dedup(rows, min_docs=2):
    """rows: (doc_id, text); what stays of each."""
    key = lambda line: line.strip(BLANK).translate(LOWER)
    seen = collections.defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            if d is not None and len(key(line)) >= 10:
                seen[key(line)].add(d)
    gone = lambda d, line: d is not None and len(seen.get(key(line), ())) >= min_docs and d != min(seen[key(line)])
    return [(d, "\n".join(line for line in (t or "").split("\n") if not gone(d, line))) for d, t in rows]


@pytest.mark.parametrize("min_docs", [2, 3])
def test_line_dedup(spark, odd_docs, no_docs, tables, min_docs):
    for docs in (odd_docs, spark.read.parquet(f"{tables}/documents.parquet"), no_docs):
        out = line_dedup.dedup_lines(docs, min_docs=min_docs)
        got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr)
        assert got == sorted(plain_dedup([(r["doc_id"], r["text"]) for r in docs.collect()], min_docs), key=repr)
        assert set(docs.columns) <= set(out.columns)


def plain_counts(text):
    text = text or ""
    w = WORD.findall(text)
    windows = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    covered = {j for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark, odd_docs, tables):
    extra = spark.createDataFrame([(90, "a b c d e a b c d e x"), (91, "r " * 40), (92, "a b c d e f\na b c d e f\n\n \na b c d e f")], "doc_id bigint, text string")
    for docs in (odd_docs, extra, spark.read.parquet(f"{tables}/documents.parquet")):
        got = sorted(tuple(r)[1:] for r in quality_rules.text_counts(docs).select("doc_id", *quality_rules.COUNTS).collect())
        assert got == sorted(plain_counts(r["text"]) for r in docs.collect())


def test_decision_list_learns_thresholds(spark):
    rows = [(i, i % 40, 100 + i % 7) for i in range(1200)]
    counts = spark.createDataFrame([(i, n, 5 * n, s if junk else 0, 0, 0, 1, 0, 0, n) for i, s, n in rows for junk in [i % 4 == 0]], "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_lines bigint, n_upper bigint, n_marks bigint, n_distinct_words bigint")
    labels = spark.createDataFrame([(i, int(not (i % 4 == 0 and s > 10))) for i, s, _ in rows], "doc_id bigint, quality int")
    rules = quality_rules.learn_decision_list(counts, labels)
    assert len(rules.rules) == 1 and [c.name for c in rules.rules[0]] == ["symbols_per_word"] and "-> junk" in str(rules)
    caught = counts.where(rules.rule().isNotNull()).count()
    expected = sum(i % 4 == 0 and s > 10 for i, s, _ in rows)  # thresholds are quantiles, so a few lie beside the cut
    assert 0.95 * expected <= caught <= 1.05 * expected


def test_judge(spark, odd_docs, no_docs, labels, tables):
    verdict, rules = quality_rules.judge(odd_docs, labels)
    assert verdict.count() == odd_docs.count() and verdict.where("n_words < 10 and kept").count() == 0
    assert quality_rules.judge(no_docs, labels)[0].count() == 0
    alone = labels.where("quality = 1")
    assert quality_rules.judge(odd_docs, alone)[1].rules == []
    docs, marks = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    verdict, rules = quality_rules.judge(docs, marks)
    seen = {(r["quality"], r["kept"]): r["n"] for r in verdict.join(marks, "doc_id").where("not base_failed").groupBy("quality", "kept").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()}
    assert seen[1, True] > 0.97 * (seen[1, True] + seen.get((1, False), 0))
    assert seen.get((0, True), 0) < 0.2 * seen.get((0, False), 1)


CHANGE = "change string, source string, lang string, tokenizer_version string, n_tokens bigint, old_n_tokens bigint, attempt string"


def test_rollup(spark):
    rollup = token_rollup.TokenRollup(spark, new_path(spark, "test-rollup"))
    totals = lambda: {(r["source"], r["lang"]): (r["n_docs"], r["n_tokens"]) for r in rollup.totals().collect()}
    change = lambda *rows: spark.createDataFrame([(c, s, l, "v1", n, o, "clash") for c, s, l, n, o in rows], CHANGE)
    assert totals() == {}
    first = change(("insert", "a", "en", 10, None), ("insert", "a", "en", 5, None), ("insert", None, None, None, None))
    assert rollup.commit("b1", first) and totals() == {("a", "en"): (2, 15), (None, None): (1, 0)}
    assert not rollup.commit("b1", first) and totals()["a", "en"] == (2, 15)
    assert rollup.commit("b2", change(("revise", "a", "en", 7, 10), ("delete", "a", "en", None, 5), ("insert", "b", "en", 5, None)))
    expected = {("a", "en"): (1, 7), ("b", "en"): (1, 5), (None, None): (1, 0)}
    assert totals() == expected
    assert rollup.commit("empty", change().limit(0)) and totals() == expected
    assert rollup.compact("s1") and not rollup.compact("s1") and totals() == expected
    assert not rollup.commit("b2", first) and totals() == expected
    with pytest.raises(Exception, match="insert, delete or revise"):
        rollup.commit("b3", change(("upsert", "a", "en", 1, 1)))
    assert totals() == expected
    rollup.commit("b4", change(("delete", "b", "en", None, 5)))
    assert rollup.compact("s2") and ("b", "en") not in totals()


@pytest.mark.parametrize("cut", ["in the delta", "before the record", "in the record"])
def test_rollup_cut_off(spark, tmp_path, cut):
    """A driver that dies at any point of a commit leaves a batch that can be committed anew, and counts once."""
    rollup = token_rollup.TokenRollup(spark, f"file://{tmp_path}/rollup")
    change = lambda *rows: spark.createDataFrame([(c, s, l, "v1", n, o, "clash") for c, s, l, n, o in rows], CHANGE)
    batch = change(("insert", "a", "en", 10, None))

    class Dies(Exception):
        pass

    class Dying(token_rollup.TokenRollup):
        def _write_delta(self, attempt, delta):
            if cut == "in the delta":
                half_written("deltas", attempt)
            super()._write_delta(attempt, delta)

        def _write_record(self, batch_id, attempt, covers):
            if cut == "in the record":
                half_written("commits", attempt)
            raise Dies

    def half_written(name, attempt):
        left = tmp_path / "rollup" / name / attempt / "_temporary" / "0" / "task"
        left.mkdir(parents=True)
        (left / "part-0.parquet").write_bytes(b"PAR1 cut")
        raise Dies

    for _ in range(2):
        with pytest.raises(Dies):
            Dying(spark, rollup.path).commit("b1", batch)
        assert rollup.totals().count() == 0
    assert rollup.commit("b1", batch) and not rollup.commit("b1", batch)
    with pytest.raises(Dies):
        Dying(spark, rollup.path).compact("s1")
    assert rollup.compact("s1")
    assert [(r["n_docs"], r["n_tokens"]) for r in rollup.totals().collect()] == [(1, 10)]


def test_rollup_two_writers_of_a_batch(spark):
    rollup = token_rollup.TokenRollup(spark, new_path(spark, "test-rollup"))
    delta = spark.createDataFrame([("a", "en", "v1", 1, 10)], "source string, lang string, tokenizer_version string, d_docs bigint, d_tokens bigint")
    total = lambda: [(r["n_docs"], r["n_tokens"]) for r in rollup.totals().collect()]
    for attempt in ("b", "c", "a"):  # the smallest attempt comes last and takes over
        rollup._write_delta(attempt, delta)
        rollup._write_record("b1", attempt, [])
        assert total() == [(1, 10)]
    assert rollup.compact("s1") and total() == [(1, 10)]
    rollup._write_delta("0", delta)
    rollup._write_record("b1", "0", [])  # a late attempt of a batch that a summary covers
    assert total() == [(1, 10)] and not rollup.commit("b1", delta)
    for nameless in (None, ""):
        with pytest.raises(ValueError, match="needs an id"):
            rollup.commit(nameless, delta)


def test_bpe_counts(odd_docs, vocabulary):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary)
    got = sorted(r["n_tokens"] for r in token_rollup.bpe_counts(odd_docs, vocabulary).collect())
    assert got == sorted(len(t.encode(r["text"] or "", add_special_tokens=False).ids) for r in odd_docs.collect())
