"""Learned decision lists over statistics of texts, with Spark's own functions only.

The statistics of each text come from one projection. Sequential covering then learns, from the
statistics of labelled documents, an ordered list of conjunctions of thresholds that reject junk:
each rule grows by the condition of best information gain on two thirds of the documents that no
earlier rule covers, and is cut back to the prefix that does best on the other third. Every step
asks Spark for counts by statistic and bin, so the driver holds counts only. The list becomes one
conditional expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajix.llm.scratch import written
from trajix.llm.sqltext import BLANK_RUN, BLANKS, let, words

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_lines", "n_upper", "n_marks", "n_distinct_words"]
WINDOW = 5


def _repeated(w: Column) -> Column:
    """Words in windows of five that the text has twice or more; ``w`` is a computed array."""
    n = F.size(w)
    windows = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)])))

    def covered(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def again(s: Column) -> Column:
            return F.sort_array(F.transform(F.filter(s, lambda x, k: (F.get(s, k - 1).h == x.h) | (F.get(s, k + 1).h == x.h)), lambda x: x.i))

        def total(p: Column) -> Column:  # each window adds the words up to the next one
            return F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)

        return let(let(ordered, again), total)

    return let(windows, lambda h: F.when(F.size(h) > F.size(F.array_distinct(h)), covered(h)).otherwise(F.lit(0)))


def _counted(text: Column) -> list[Column]:
    """Structs w and l and further columns that hold the counts of a whole text; a null text has none of anything."""
    text = F.coalesce(text.cast("string"), F.lit(""))

    def counts(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            F.char_length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
            F.size(F.array_distinct(w)).cast("bigint").alias("n_distinct_words"),
            _repeated(w).cast("bigint").alias("n_repeat_words"),
        )

    lines = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(BLANKS)) != "")
    by_line = let(lines, lambda a: F.struct(F.size(a).cast("bigint").alias("n_lines"), (F.size(a) - F.size(F.array_distinct(a))).cast("bigint").alias("n_dup_lines")))
    return [
        let(words(text), counts).alias("w"),
        by_line.alias("l"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        F.regexp_count(text, F.lit(r"\p{Lu}")).cast("bigint").alias("n_upper"),
        F.regexp_count(text, F.lit("[!?]")).cast("bigint").alias("n_marks"),
    ]


def text_counts(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of each whole text."""
    made = docs.select("doc_id", *_counted(F.col("text")))
    return made.select("doc_id", "w.*", "l.*", "n_symbols", "n_upper", "n_marks").select("doc_id", *COUNTS, *MORE)


def statistics() -> dict[str, Column]:
    """What rules test: shares and means of the counts, 0 where a text has no words."""

    def share(a: str, b: str) -> Column:
        return F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0)).cast("double")

    return {
        "symbols_per_word": share("n_symbols", "n_words"),
        "marks_per_word": share("n_marks", "n_words"),
        "upper_share": share("n_upper", "word_chars"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "distinct_share": share("n_distinct_words", "n_words"),
        "chars_per_word": share("word_chars", "n_words"),
        "words_per_line": share("n_words", "n_lines"),
        "n_words": F.col("n_words").cast("double"),
    }


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool  # value >= cut, else value < cut
    cut: float
    bin: int

    def column(self) -> Column:
        value = statistics()[self.name]
        return value >= F.lit(self.cut) if self.above else value < F.lit(self.cut)

    def on_bins(self) -> Column:
        return F.col(self.name) >= self.bin if self.above else F.col(self.name) < self.bin

    def __str__(self) -> str:
        return f"{self.name} {'>=' if self.above else '<'} {self.cut:.6g}"


@dataclass
class DecisionList:
    """Rules in order; a text that meets all conditions of one is junk, any other is kept."""

    rules: list[list[Condition]] = field(default_factory=list)

    def rule(self) -> Column:
        """Number, from 1, of the first rule that holds; null for none."""
        out = F.lit(None).cast("int")
        for k, rule in reversed(list(enumerate(self.rules, 1))):
            out = F.when(_all(c.column() for c in rule), F.lit(k)).otherwise(out)
        return out

    def __str__(self) -> str:
        return "\n".join(" and ".join(map(str, r)) + " -> junk" for r in self.rules) + "\notherwise -> keep"


def _all(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def learn_decision_list(
    counts: DataFrame,
    labels: DataFrame,
    bins: int = 48,
    max_rules: int = 8,
    max_conditions: int = 3,
    min_precision: float = 0.9,
    min_covered: int = 5,
    seed: int = 29,
) -> DecisionList:
    """Learn from the counts of documents that ``labels`` (doc_id, quality 0 or 1) marks.

    A rule is taken while at least ``min_precision`` of what it covers among the documents kept for
    pruning is junk, and it covers ``min_covered`` documents in all. Documents marked both ways, null
    marks and null ids are left out; without junk or without good documents the list is empty.
    """
    marks = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("lo"), F.max("quality").alias("hi")).where("lo = hi")
    known = counts.join(marks, "doc_id").select(
        (F.col("lo") == 0).cast("int").alias("junk"),
        (F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(3)) == 0).cast("int").alias("held"),
        *[c.alias(n) for n, c in statistics().items()],
    )
    known = written(known, "rule-statistics")
    names = list(statistics())
    parts = [i / bins for i in range(1, bins)]
    asked = [F.percentile_approx(F.when(F.col("junk") == side, F.col(n)), parts, 2000).alias(f"{n}_{side}") for n in names for side in (0, 1)]
    row = known.agg(*asked, F.sum("junk").alias("__junk"), F.count("*").alias("__all")).first()
    if not row["__junk"] or row["__junk"] == row["__all"]:
        return DecisionList()
    cuts = {n: sorted({*row[f"{n}_0"], *row[f"{n}_1"]}) for n in names}
    binned = known.select("junk", "held", *[_bin(F.col(n), cuts[n]).alias(n) for n in names])
    binned = written(binned, "rule-bins")

    out = DecisionList()
    left = binned
    while len(out.rules) < max_rules:
        rule = _grow(left, names, cuts, max_conditions)
        if not rule:
            break
        rule, precision, covered = _prune(left, rule)
        if precision < min_precision or covered < min_covered:
            break
        out.rules.append(rule)
        left = left.where(~_all(c.on_bins() for c in rule))
    return out


def _bin(value: Column, cuts: list[float]) -> Column:
    """How many of the ascending cuts the value reaches."""
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda t: t <= value))


def _grow(left: DataFrame, names: list[str], cuts: dict[str, list[float]], most: int) -> list[Condition]:
    rule: list[Condition] = []
    while len(rule) < most:
        covered = left.where("held = 0").where(_all(c.on_bins() for c in rule))
        by_bin = (
            covered.select("junk", F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.col(n).alias("b")) for n in names])).alias("x"))
            .groupBy("x.n", "x.b")
            .agg(F.sum("junk").alias("p"), F.count("*").alias("all"))
            .collect()
        )
        hist: dict[str, dict[int, tuple[int, int]]] = {n: {} for n in names}
        for r in by_bin:
            hist[r["n"]][r["b"]] = (r["p"], r["all"] - r["p"])
        p = sum(v[0] for v in hist[names[0]].values())
        q = sum(v[1] for v in hist[names[0]].values())
        if not p or not q:
            break
        best: tuple[float, Condition] | None = None
        for n in names:
            low_p = low_q = 0
            for b, cut in enumerate(cuts[n], 1):  # bins below b hold values under the cut
                add = hist[n].get(b - 1, (0, 0))
                low_p, low_q = low_p + add[0], low_q + add[1]
                for above, cp, cq in ((True, p - low_p, q - low_q), (False, low_p, low_q)):
                    if cp:
                        gain = cp * (math.log2(cp / (cp + cq)) - math.log2(p / (p + q)))
                        if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                            best = gain, Condition(n, above, cut, b)
        if best is None:
            break
        rule.append(best[1])
    return rule


def _prune(left: DataFrame, rule: list[Condition]) -> tuple[list[Condition], float, int]:
    """The shortest prefix with the best (p - n) / (p + n) on held documents; its smoothed precision and cover."""
    asked = []
    for k in range(1, len(rule) + 1):
        on = _all(c.on_bins() for c in rule[:k])
        held = on & (F.col("held") == 1)
        asked += [F.count_if(held & (F.col("junk") == 1)).alias(f"p{k}"), F.count_if(held).alias(f"h{k}"), F.count_if(on).alias(f"a{k}"), F.count_if(on & (F.col("junk") == 1)).alias(f"j{k}")]
    row = left.agg(*asked).first()
    k = max(range(1, len(rule) + 1), key=lambda k: ((2 * row[f"p{k}"] + 1) / (row[f"h{k}"] + 1), -k))
    held = row[f"h{k}"]
    precision = row[f"p{k}"] / held if held >= 5 else row[f"j{k}"] / max(1, row[f"a{k}"])
    return rule[:k], precision, row[f"a{k}"]


def base_failed(min_words: int = 10, repeat_percent: int = 20) -> Column:
    """Under ``min_words`` words, or more than ``repeat_percent`` of them in repeated windows."""
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))


def judge(docs: DataFrame, labels: DataFrame, min_words: int = 10, repeat_percent: int = 20, **learning) -> tuple[DataFrame, DecisionList]:
    """Counts and verdict of each document, and the list that gave the verdicts.

    Columns: doc_id, the counts, base_failed, rule (the rule that rejects it, or null) and
    kept. Null and empty texts have no words and fail the base; a null doc_id is judged like any
    other; repeated rows are judged each; an empty table gives no rows; other columns are not
    looked at.
    """
    counts = written(text_counts(docs), "text-counts")
    rules = learn_decision_list(counts, labels, **learning)
    verdict = counts.withColumn("base_failed", base_failed(min_words, repeat_percent)).withColumn("rule", rules.rule())
    return verdict.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull()), rules


def keep_documents(docs: DataFrame, labels: DataFrame, min_words: int = 10, repeat_percent: int = 20, **learning) -> DataFrame:
    """The rows of ``docs``, all columns, that pass the base rules and a list learned on the labelled ones.

    The verdict never leaves its row, so rows without a doc_id, and rows that share one, are judged each
    by their own text. The list is that of ``judge``. An empty table gives no rows.
    """
    named = labels.where("doc_id is not null").select(F.col("doc_id").alias("__labelled")).distinct()
    counts = written(text_counts(docs.select("doc_id", "text").join(named, F.col("doc_id") == F.col("__labelled"), "left_semi")), "text-counts")
    rules = learn_decision_list(counts, labels, **learning)
    # a row of one array: filters don't pass through it, so each text is counted once
    counted = docs.select(F.struct("*").alias("__row"), F.inline(F.array(F.struct(*_counted(F.col("text"))))))
    counted = counted.select("__row", "w.*", "l.*", "n_symbols", "n_upper", "n_marks")
    return counted.where(~base_failed(min_words, repeat_percent) & rules.rule().isNull()).select("__row.*")
