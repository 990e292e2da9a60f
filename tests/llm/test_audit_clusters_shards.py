"""Filter audit, ball-tree clusters and minimax shards against plain Python."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest

from trajix.llm import ball_clusters, filter_audit, sharding
from trajix.llm.ball_clusters import BallTree, cluster_vectors, distances, with_inertia
from trajix.llm.scratch import new_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_mask(text):
    w = WORD.findall(text)
    return (len(w) < 200) + 2 * (100 * len(set(w)) < 50 * len(w)) + 4 * (100 * len(re.findall("[A-Z]", text)) > 3 * len(text)) + 8 * bool(re.search("[#$%&*|]", text))


def plain_audit(rows, labels):
    """rows: (doc_id, text, lang); labels: (doc_id, quality, toxic)."""
    rows = [(d, t or "", g or "") for d, t, g in rows]
    first = {}
    for d, t, _ in rows:
        if d is not None:
            first[t] = min(first.get(t, d), d)
    good, toxic = ({d for d, *marks in labels if d is not None and marks[k] == 1} for k in (0, 1))
    masks = [(g, plain_mask(t) + 16 * (d is not None and first[t] < d), d in good, d in toxic) for d, t, g in rows]
    out, shapley = {}, collections.Counter()
    for part in {m[0] for m in masks}:
        own = [m[1:] for m in masks if m[0] == part]
        for order in itertools.permutations("ABCDE"):
            gone = 0
            for k, c in enumerate(order):
                bit = 1 << "ABCDE".index(c)
                hit = [m for m in own if m[0] & bit and not m[0] & gone]
                counts = sum(not m[0] & (gone | bit) for m in own), len(hit), sum(bool(m[0] & bit and m[0] & gone) for m in own), sum(m[0] == bit for m in own)
                out[part, "".join(order), k + 1] = (*counts, sum(m[1] for m in hit), sum(m[2] for m in hit))
                shapley[part, c] += len(hit)
                gone |= bit
    return {key: (*v, shapley[key[0], key[1][key[2] - 1]]) for key, v in out.items()}


def audited(df):
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in filter_audit.COUNTS) for r in df.collect()}


def test_audit_of_odd_rows(spark, odd_docs, no_docs, labels):
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in odd_docs.collect()]
    marks = [tuple(r) for r in labels.collect()]
    assert audited(filter_audit.audit_filters(odd_docs, labels)) == plain_audit(rows, marks)
    assert audited(filter_audit.audit_filters(odd_docs, labels.where("false"))) == plain_audit(rows, [])
    assert filter_audit.audit_filters(no_docs, labels).count() == 0


def test_copies_over_many_ranges(spark):
    """One group of copies that most ranges hold, repeated ids and rows without an id among them, and equal fingerprints near it."""
    rng = random.Random(4)
    rows = [(rng.randrange(700), "the same text " * 80, "en") for _ in range(900)] + [(None, "the same text " * 80, "en")] * 5
    rows += [(rng.randrange(2000), f"text {rng.randrange(150)}", rng.choice(["en", None, "de"])) for _ in range(600)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(7)
    labels = spark.createDataFrame([(i, i % 2, i % 3) for i in range(0, 700, 5)], "doc_id bigint, quality int, toxic int")
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = audited(filter_audit.audit_filters(docs, labels))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == plain_audit(rows, [tuple(r) for r in labels.collect()])


def test_masks_of_long_and_foreign_texts(monkeypatch):
    limits = filter_audit.Limits()
    texts = ["", "é" * 50 + "A", "x" * 300, "a b   c " * 200, "A b\tc\x0bd\x1fe " * 300, "w " * 399 + "| B", " ".join(f"w{i}" for i in range(5000)), "\n\t "]
    for step in (1, 7, 1 << 20):
        monkeypatch.setattr(filter_audit, "STEP", step)
        assert [limits.mask(t.encode()) for t in texts] == [plain_mask(t) for t in texts]


def plain_clusters(rows, k=16, rounds=3):
    kept = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted(((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None))[:k]
    centroids = [v for _, v in named]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda v: min(range(len(centroids)), key=lambda c: (square(v, centroids[c]), c))
    for _ in range(rounds):
        own = collections.defaultdict(list)
        for _, v in kept:
            own[nearest(v)].append(v)
        centroids = [[sum(c) // len(own[j]) for c in zip(*own[j])] if own[j] else m for j, m in enumerate(centroids)]
    out = [(i, c, square(v, centroids[c])) for i, v in kept for c in [nearest(v)]]
    each = collections.Counter()
    for _, c, d in out:
        each[c] += d
    sha = lambda c: hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()
    return sorted([(i, c, d, each[c], sum(each.values()), sha(c)) for i, c, d in out], key=repr)


def clustered(rows, **how):
    return sorted([tuple(r) for r in with_inertia(cluster_vectors(rows, **how)).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()], key=repr)


@pytest.mark.parametrize("block_rows, leaf", [(4096, 32), (50, 2), (7, 1)])
def test_clusters_of_odd_vectors(spark, block_rows, leaf):
    rng = np.random.default_rng(2)
    heart = rng.normal(size=(5, 64)) * 3
    vectors = [(heart[i % 5] + (i % 3 > 0) * rng.normal(size=64)).tolist() for i in range(300)]
    rows = [(i, v) for i, v in enumerate(vectors)] + [(3, vectors[3]), (3, vectors[4]), (None, vectors[7])] + [(1000 + i, vectors[0]) for i in range(120)]
    rows += [(500, None), (501, []), (502, [1.0] * 63), (503, [None] + [1.0] * 63), (504, [float("nan")] * 64), (505, [float("inf")] * 64), (506, [0.0] * 64), (507, [-0.25] * 64)]
    table = spark.createDataFrame([(i, v, 9, 8.0) for i, v in rows], "vec_id bigint, embedding array<double>, cluster int, distance double").repartition(3)
    assert clustered(table, block_rows=block_rows, leaf=leaf) == plain_clusters(rows)


def test_few_vectors_and_large_components(spark):
    schema = "vec_id bigint, embedding array<double>"
    assert clustered(spark.createDataFrame([], schema)) == []
    few = [(i, [float(i)] * 64) for i in range(3)]
    assert clustered(spark.createDataFrame(few, schema)) == plain_clusters(few)
    large = [(i, [1e30 if i % 2 else -1e30] * 32 + [float(i)] * 32) for i in range(20)]
    held = [(i, [max(-(2.0**21), min(2.0**21, x)) for x in v]) for i, v in large]
    got = clustered(spark.createDataFrame(large, schema), k=4)
    assert got == [(*r[:3], *(min(x, (1 << 63) - 1) for x in r[3:5]), r[5]) for r in plain_clusters(held, k=4)]


def test_ball_tree_and_exact_distances():
    rng = np.random.default_rng(1)
    for scale in (40, 1 << 26):
        x = rng.integers(-scale, scale, (500, 64)) // (1 + (np.arange(500) % 5)[:, None] * 100)
        c = rng.integers(-scale, scale, (9, 64))
        plain = np.array([[sum((int(a) - int(b)) ** 2 for a, b in zip(v, w)) for w in c] for v in x[:40]])
        assert (distances(x[:40], c) == plain).all()
        tree, order = BallTree.build(x, 8)
        assert sorted(order.tolist()) == list(range(500)) and (tree.x == x[order]).all() and (tree.total[0] == x.sum(0)).all()
        again = BallTree.unpacked(tree.packed(), 64)
        for lo, hi, cluster, total in again.filtered(c):
            assert (np.broadcast_to(cluster, hi - lo) == distances(x[order[lo:hi]], c).argmin(1)).all()
            assert total is None or (total == x[order[lo:hi]].sum(0)).all()
    whole = [total for *_, total in BallTree.build(np.repeat(c, 60, axis=0), 4)[0].filtered(c)]
    assert sum(t is not None for t in whole) >= 9  # balls around centroids go whole


def plain_capacity(sizes, shards):
    def fits(capacity):
        used, room = 1, capacity
        for s in sizes:
            if s > capacity:
                return False
            if s > room:
                used, room = used + 1, capacity
            room -= s
        return used <= shards

    lo, hi = 0, sum(sizes)
    while lo < hi:
        guess = (lo + hi) // 2
        lo, hi = (lo, guess) if fits(guess) else (guess + 1, hi)
    return lo


@pytest.mark.parametrize("n, first_bits, more_bits", [(3000, 13, 4), (3000, 3, 2), (2000, 1, 1), (10, 13, 4), (40, 4, 4)])
def test_smallest_capacity(spark, monkeypatch, n, first_bits, more_bits):
    monkeypatch.setattr(sharding, "FIRST_BITS", first_bits)
    monkeypatch.setattr(sharding, "MORE_BITS", more_bits)
    rng = random.Random(n)
    groups = [(rng.getrandbits(64) - (1 << 63), rng.choice([16, 20, 300, rng.randrange(5000)])) for _ in range(n)]
    for extra in ([], [(5, 4_000_000), (-7, 900_000)]):
        plan = sharding.plan_shards(spark.createDataFrame(groups + extra, "key bigint, bytes bigint"), 16)
        sizes = dict(groups + extra)
        rest = [s for k, s in sorted(sizes.items()) if k not in plan.alone]
        alone = [sizes[k] for k in plan.alone]
        assert not extra or {5, -7} <= set(plan.alone)
        cuts = [-math.inf if c is None else c for c in plan.cuts]
        assert cuts == sorted(cuts) and len(plan.alone) + len(cuts) == 15
        own = collections.Counter()
        for k, s in sizes.items():
            own[sum(k > c for c in cuts)] += 0 if k in plan.alone else s
        assert max(own.values()) == plain_capacity(rest, 16 - len(alone))
        assert plan.capacity == max([*own.values(), *alone])


def test_shards_of_odd_rows(spark, odd_docs, no_docs, tmp_path):
    copies = spark.createDataFrame([(7, "one large group " * 30)] * 400 + [(i, "one large group " * 30) for i in range(300)] + [(i, f"text {i}") for i in range(500)], "doc_id bigint, text string")
    for docs, shards in ((odd_docs, 40), (odd_docs, 3), (copies, 5)):
        placed, plan = sharding.shard_documents(docs, shards)
        rows, texts = placed.collect(), [r["text"] for r in docs.collect()]
        assert sorted((r["size"], r["text_crc32"]) for r in rows) == sorted((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for t in texts)
        slots, of_text = collections.defaultdict(list), collections.defaultdict(set)
        for r in rows:
            slots[r["shard"]].append(r["slot"])
            of_text[r["size"], r["text_crc32"]].add(r["shard"])
        assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(shards))
        assert all(len(s) == 1 for s in of_text.values())
        path = f"{tmp_path}/{docs.count()}-{shards}"
        sharding.write_shards(docs, plan, path)
        sizes = collections.Counter(r["shard"] for r in rows)
        for s in range(shards):
            back = sharding.read_shard(spark, path, s)
            assert back.count() == sizes[s] and set(docs.columns) <= set(back.columns)
    assert sharding.shard_documents(no_docs, 4)[0].count() == 0


def test_slots_over_many_cells(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CELL_ROWS", 10)
    docs = spark.createDataFrame([(1 if i % 3 else i, "same" if i % 3 else f"text {i}") for i in range(600)], "doc_id bigint, text string")
    slots = collections.defaultdict(list)
    for r in sharding.shard_documents(docs, 4)[0].collect():
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and sum(map(len, slots.values())) == 600


def test_shards_of_the_table(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    placed, plan = sharding.shard_documents(docs, 40)
    groups = {r["key"]: r["bytes"] for r in sharding.measured(docs).groupBy("key").agg({"size": "sum"}).toDF("key", "bytes").collect()}
    rest = [s for k, s in sorted(groups.items()) if k not in plan.alone]
    best = max([plain_capacity(rest, 40 - len(plan.alone)), *(groups[k] for k in plan.alone)])
    assert max(r["s"] for r in placed.groupBy("shard").agg({"size": "sum"}).toDF("shard", "s").collect()) == best == plan.capacity
    assert new_path(spark, "x") != new_path(spark, "x") and ball_clusters.most_component(64) == 1 << 27
