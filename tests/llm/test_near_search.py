"""Near-duplicates and nearest neighbours against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql.functions import spark_partition_id

from trajix.llm.components import components
from trajix.llm.multi_index import POPCOUNT, Shard, learn, nearest_neighbours
from trajix.llm.near_dedup import SetSketch, drop_near_duplicates, near_duplicates

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_components(rows, size, percent):
    sets = {}
    for d, text in rows:
        w = WORD.findall((text or "").translate(LOWER))
        own = frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])
        sets.setdefault(d, []).append(own)
    root = {d: d for d in sets if d is not None}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(root)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {d: find(d) for d in ids}, sets


def check(df, size, percent):
    expected, sets = plain_components([(r["doc_id"], r["text"]) for r in df.collect()], size, percent)
    got = near_duplicates(df, size, percent).collect()
    assert len(got) == df.count()
    for r in got:
        assert r["n_shingles"] in {len(s) for s in sets[r["doc_id"]]}
        assert r["component_id"] == expected.get(r["doc_id"])
        assert r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"])


@pytest.mark.parametrize("size,percent", [(3, 85), (5, 80)])
def test_documents(spark, tables, odd_docs, no_docs, size, percent):
    check(spark.read.parquet(f"{tables}/documents.parquet"), size, percent)
    check(odd_docs, size, percent)
    assert near_duplicates(no_docs, size, percent).count() == 0


def test_several_texts_under_one_id(spark, monkeypatch):
    """A document has the links of each of its texts, and joins them."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    near = lambda t, k: " ".join(w if i != k else "changed" for i, w in enumerate(t.split()))
    long = " ".join(f"z{i}" for i in range(300))
    cases = [
        [(0, b), (1, a), (1, b), (2, a)],
        [(4, a), (4, b), (5, near(a, 59)), (3, near(b, 0)), (9, c), (9, ""), (8, c), (7, None), (7, long), (6, long)],
        [(1, a), (1, long), (2, a), (2, c), (3, c), (3, None), (4, "x y"), (4, "y x"), (None, a), (None, b)],
        [(-5, a), (-5, a), (-5, b), (10, b), (10, c), (11, near(c, 59)), (12, long)],
    ]
    for rows in cases:
        check(spark.createDataFrame(rows, "doc_id bigint, text string"), 3, 85)
    from trajix.llm import near_dedup

    found = spark.createDataFrame([(1,)], "doc_id bigint")
    texts = spark.createDataFrame([(1, b"u", 5), (1, b"v", 6)], "doc_id bigint, words_key binary, t bigint")
    first = near_dedup._names(texts, found).select("name").collect()
    taken = spark.createDataFrame([(first[0]["name"],)], "doc_id bigint")  # a name that is an id: others are made
    assert not {r["name"] for r in near_dedup._names(texts, taken).collect()} & {first[0]["name"]}


def test_large_groups_of_edited_copies(spark):
    rng = random.Random(3)
    rows = []
    for group in range(3):
        base = [f"w{group}_{i}" for i in range(90)]
        for i in range(60):
            words = list(base)
            for _ in range(rng.randint(0, 5)):
                words[rng.randrange(90)] = f"x{rng.random()}"
            rows.append((1000 * group + rng.randrange(10**6) * 10 + group, " ".join(words)))
    shared = " ".join(f"s{i}" for i in range(60))
    rows += [(i * 10 + 7, shared + " " + " ".join(f"own{i}_{k}" for k in range(40))) for i in range(40)]
    check(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5), 3, 85)


def test_drop_keeps_one_of_each(odd_docs):
    kept = drop_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect())
    assert ids == [1, 2, 2, 3, 4, 5, 7, 9] and kept.where("doc_id is null").count() == 1


def test_20000_near_copies(spark):
    """One bucket with most rows in each band; and as many texts that share a passage but are not linked."""
    base = [f"w{i}" for i in range(60)]
    edited = [(7 * i + 3, " ".join(base[: i % 60] + [f"x{i}"] + base[i % 60 + 1 :])) for i in range(20_000)]
    shared = " ".join(f"s{i}" for i in range(40))
    apart = [(7 * i + 4, f"{shared} " + " ".join(f"own{i}_{k}" for k in range(12))) for i in range(3_000)]
    docs = spark.createDataFrame(edited + apart + edited[:50], "doc_id bigint, text string").repartition(6)
    rows = near_duplicates(docs, 3, 80).collect()
    assert len(rows) == 23_050
    for r in rows:
        assert r["component_id"] == (3 if r["doc_id"] % 7 == 3 else r["doc_id"]) and r["kept"] == (r["component_id"] == r["doc_id"])


def test_open_buckets_in_cells(spark, monkeypatch):
    """Cells far smaller than buckets give the same components."""
    from trajix.llm import near_dedup, scratch

    monkeypatch.setattr(near_dedup, "CELL_NODES", 4)
    monkeypatch.setattr(scratch, "LEAST_HOT_ROWS", 5)
    test_large_groups_of_edited_copies(spark)


def test_hot_keys_are_dealt_over_partitions(spark):
    from trajix.llm.scratch import join_counted

    rows = spark.range(21_000).selectExpr("if(id < 20000, 1, id) AS k", "id AS v", "'x' AS s")
    facts = spark.range(30_000).selectExpr("id AS k", "-id AS f")
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "40"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        joined = join_counted(rows, facts, "k", rows.groupBy("k").count())
        per_task = [r["count"] for r in joined.groupBy(spark_partition_id()).count().collect()]
        assert max(per_task) < 6_000 and sum(per_task) == 21_000  # 1,000 rows a part, parts hashed over 40 tasks
        assert sorted(tuple(r) for r in joined.select("k", "v", "s", "f").collect()) == sorted((1 if i < 20_000 else i, i, "x", -(1 if i < 20_000 else i)) for i in range(21_000))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_registers():
    s, rng = SetSketch(), np.random.default_rng(0)
    values = rng.integers(0, 2**64, 3000, np.uint64)
    a, b = values[:2000], values[400:2400]
    both = s.registers(np.concatenate([a, b, np.concatenate([a, values[2000:2400]])]), np.array([0, 2000, 4000, 6400]))
    assert (s.merge(both[0], both[1]) == both[2]).all()  # registers of a union
    found, _ = s.estimate(both[:1], both[1:2], np.array([2000]), np.array([2000]))
    assert abs(found[0] - 1600 / 2400) < 0.15
    assert s.may_reach(both[:1], both[1:2], np.array([2000]), np.array([2000]), 0.66)[0]
    far = s.registers(rng.integers(0, 2**64, 2000, np.uint64), np.array([0, 2000]))
    assert not s.may_reach(both[:1], far, np.array([2000]), np.array([2000]), 0.8)[0]
    assert (s.registers(np.zeros(0, np.uint64), np.array([0, 0])) == 0).all()


def test_slack_of_the_likelihood(spark, tables):
    """Of pairs at the asked similarity none of 2,000 is left out, also at less slack; without bound no pair is."""
    rng = np.random.default_rng(9)
    for similarity, n in ((0.85, 400), (0.8, 60)):
        s = SetSketch()
        common = int(round(2 * n * similarity / (1 + similarity)))
        sets = [rng.integers(0, 2**64, 2 * n - common, np.uint64) for _ in range(2000)]
        x, y = (s.registers(np.concatenate([v[:n] if k == 0 else v[n - common :] for v in sets]), np.arange(2001) * n) for k in (0, 1))
        size = np.full(2000, n)
        assert s.may_reach(x, y, size, size, similarity).all() and SetSketch(slack=8.0).may_reach(x, y, size, size, similarity).all()
    other = s.registers(rng.integers(0, 2**64, 2000 * n, np.uint64), np.arange(2001) * n)
    assert not s.may_reach(x, other, size, size, 0.8).any() and SetSketch(slack=np.inf).may_reach(x, other, size, size, 0.8).all()
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    key = lambda df: sorted((r["doc_id"], r["component_id"]) for r in df.collect())
    assert key(near_duplicates(docs, 3, 85)) == key(near_duplicates(docs, 3, 85, SetSketch(slack=np.inf)))


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(None, 1), (5, 5)]
    root = {}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a, b in edges:
        if a is not None and a != b:
            for d in (a, b):
                root.setdefault(d, d)
            low, high = sorted((find(a), find(b)))
            root[high] = low
    got = components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert {r["node"]: r["root"] for r in got} == {d: find(d) for d in root} and len(got) == len(root)
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
    star = [(9_999, i) for i in range(5_000)] + [(20_000, i) for i in range(4_000, 7_000)]  # hubs that are not the smallest
    got = components(spark.createDataFrame(star, "a bigint, b bigint").repartition(4)).collect()
    assert len(got) == 7_002 and {r["root"] for r in got} == {0}


def test_probing_meets_every_code_in_the_radius():
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 256, (2000, 6), np.uint8)
    shard = Shard(codes)
    for radius in (0, 5, 11, 17, 48):
        for q in (codes[7], rng.integers(0, 256, 6, np.uint8), np.full(6, 255, np.uint8)):
            near = np.flatnonzero(POPCOUNT[codes ^ q].sum(1) <= radius)
            assert shard.within(q, radius).tolist() == near.tolist()


VECTORS = "vec_id bigint, embedding array<float>, score double, ids string"


def brute(rows, queries, k):
    usable = {(i, tuple(v)) for i, v in rows if i is not None and v is not None and len(v) == 8 and None not in v and np.isfinite(v).all() and any(v)}
    out = {}
    for q, v in queries:
        if (q, tuple(v)) in usable:
            best = {}
            for i, w in usable:
                if i != q:
                    d = float(np.sqrt(((np.array(w, float) - np.array(v, float)) ** 2).sum()))
                    best[i] = min(d, best.get(i, d))
            out[q] = sorted(best.items(), key=lambda x: (round(x[1], 9), x[0]))[:k]
    return out


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(4)
    rows = [(i, np.float32(v).tolist()) for i, v in enumerate(rng.normal(size=(300, 8)))]
    rows += [(i, rows[7][1]) for i in range(300, 380)]  # many copies of one vector
    rows += [(380, None), (381, [0.0] * 8), (382, [1.0, None] + [0.0] * 6), (383, [float("nan")] * 8), (384, [1.0] * 5), (None, rows[3][1]), (5, rows[5][1])]
    df = spark.createDataFrame([(i, v, 1.0, "clash") for i, v in rows], VECTORS).repartition(4)
    queries = df.where("vec_id % 20 = 0")
    expected = brute(rows, [r for r in rows if r[0] is not None and r[0] % 20 == 0 and r[1] is not None and len(r[1]) == 8 and r[1][0] == r[1][0] and any(r[1])], 10)
    got = {}
    for r in nearest_neighbours(df, queries, shard_rows=100, block_queries=7).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert got.keys() == expected.keys()
    hits = sum(len({v for _, v, _ in got[q]} & {v for v, _ in expected[q]}) for q in expected)
    assert hits >= 0.9 * sum(map(len, expected.values()))
    for q, found in got.items():
        assert [n for n, _, _ in found] == list(range(1, len(found) + 1)) and len(found) == 10
        assert [(s, v) for _, v, s in found] == sorted((s, v) for _, v, s in found) and q not in [v for _, v, _ in found]
    assert [(v, s) for _, v, s in got[300]] == [(7, 0.0)] + [(i, 0.0) for i in range(301, 310)]
    assert nearest_neighbours(df.where("false"), queries).count() == 0
    few = df.where("vec_id in (1, 2, 3)")
    assert nearest_neighbours(few, few).count() == 6
    twice = spark.createDataFrame([(1, [0.0, 1.0]), (1, [5.0, 0.0]), (2, [5.0, 1.0]), (3, [0.0, 3.0])], "vec_id bigint, embedding array<double>")
    found = {(r["query_id"], r["vec_id"]): r["score"] for r in nearest_neighbours(twice, twice).collect()}
    assert found[1, 2] == found[2, 1] == 1.0 and found[1, 3] == found[3, 1] == 2.0  # the nearer of its two vectors


def test_recall_on_embeddings(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r["vec_id"], np.array(r["embedding"], float)) for r in df.collect()]
    x, ids = np.stack([v for _, v in rows]), np.array([i for i, _ in rows])
    got, hits = {}, 0
    for r in nearest_neighbours(df, df.where("vec_id % 20 = 0")).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    for q, found in got.items():
        d = ((x - x[ids == q]) ** 2).sum(1)
        d[ids == q] = np.inf
        hits += len(found & set(ids[np.lexsort((ids, d))[:10]].tolist()))
    assert len(got) == 25 and hits >= 0.9 * 250


def test_codes_are_whole_bytes():
    for dim in (3, 8, 12):
        coder = learn(np.random.default_rng(0).normal(size=(50, dim)))
        assert coder.codes(np.zeros((2, dim))).shape[1] >= 1
