"""Token ids, packing and token files against the tokenizers library alone."""

import json
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer
import public_tokenizers

from trajix.llm.bpe_ids import RunBpe, steps
from trajix.llm.packing import BinTree, first_fit_decreasing, pack_documents
from trajix.llm.scratch import BATCH_BYTES, new_path, written
from trajix.llm.token_files import BIT, BYTE, chunk_index, decode_chunk, encode_chunk, read_token_files, write_and_index, write_token_files

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
TEXT = st.lists(st.sampled_from([*"abzAZ059 .,'!\n\t<|>sdmtrevl\x0b\x0c\x1c\x7f\x85\xa0×÷ÀÿßÞµéÉİΣς中😀́", "'re", "'LL", "<|endoftext|>"]), max_size=40).map("".join)


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=8), st.integers(0, 3))
def test_ids_are_the_library_s(texts, skip):
    part = pa.array(texts, pa.large_string()).slice(min(skip, len(texts) - 1))
    ids, first = RunBpe.of(PATH).encode(part)
    for i, text in enumerate(part.to_pylist()):
        assert ids[first[i] : first[i + 1]].tolist() == ids_of(text)


def test_steps_cover_all_rows():
    texts = pa.array(["x" * 5_000_000, None, "y" * 5_000_000, "z"] * 3)
    found = [(at, len(t)) for at, t in steps(texts)]
    assert sum(n for _, n in found) == len(texts) and len(found) > 2
    assert list(steps(pa.array([], pa.string()))) == []


@given(st.lists(st.integers(1, 50), max_size=60))
def test_first_fit_decreasing(lengths):
    bins, offsets = first_fit_decreasing(np.array(lengths, np.int64), 50)
    left = []  # first fit, the plain way
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        k = next((k for k, room in enumerate(left) if room >= lengths[i]), len(left))
        left += [50] * (k == len(left))
        assert (bins[i], offsets[i]) == (k, 50 - left[k])
        left[k] -= lengths[i]


def test_tree_of_one_bin():
    assert BinTree(1, 10).put(10) == (0, 10)


def test_packing(odd_docs, no_docs, vocabulary):
    rows = pack_documents(odd_docs, vocabulary, capacity=512, docs_per_group=4, with_ids=True).toPandas()
    whole = {(r["doc_id"], r["text"]) for r in odd_docs.collect()}
    assert rows["length"].max() <= 512
    for _, g in rows.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert (g["offset"].values == np.cumsum(g["length"]) - g["length"]).all()
        used = g["length"].sum()
        assert (g["padding"] == (0 if used & (used - 1) == 0 else 512 - used)).all()
    for doc_id, text in whole:
        own = [*ids_of(text), 2]
        g = rows[(rows["doc_id"].isna() if doc_id is None else rows["doc_id"] == doc_id) & (rows["doc_tokens"] == len(own))]
        for start, n, crc, ids in zip(g["start"], g["length"], g["ids_crc32"], g["token_ids"]):
            assert list(ids) == own[start : start + n] and crc == zlib.crc32(np.array(ids, "<u4").tobytes())
        copies = 2 if doc_id == 2 else 1
        assert g["length"].sum() == copies * len(own)
    assert pack_documents(no_docs, vocabulary).count() == 0


def test_little_padding(spark, tables, vocabulary):
    rows = pack_documents(spark.read.parquet(f"{tables}/documents.parquet"), vocabulary).toPandas()
    assert rows["length"].sum() > 0.97 * 4096 * (rows["sequence_id"].nunique() - 1)


@settings(max_examples=60)
@given(st.lists(st.integers(0, 2**32 - 1), min_size=0, max_size=300), st.sampled_from([BIT, BYTE]))
def test_chunks_round_trip(ids, width):
    assert decode_chunk(encode_chunk(np.array(ids, "<u4"), width)).tolist() == ids


def test_token_files(spark, odd_docs, no_docs, vocabulary):
    for planes in (BIT, BYTE):
        path = new_path(spark, "test-tokens")
        write_token_files(odd_docs, path, vocabulary, chunk_ids=1000, planes=planes)
        got = read_token_files(spark, path, with_ids=True).orderBy("part", "local_start").collect()
        rows = sorted(odd_docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
        assert [r["doc_id"] for r in got] == [r["doc_id"] for r in rows]
        assert [r["token_ids"] for r in got] == [[*ids_of(r["text"]), 1] for r in rows]
        index = chunk_index(spark, path).collect()
        assert sum(r["n_ids"] for r in index) == sum(len(r["token_ids"]) for r in got) and max(r["n_ids"] for r in index) == 1000
    start = 0
    for r in write_and_index(odd_docs.where("doc_id > 2"), vocabulary).orderBy("doc_id").collect():
        assert r["start"] == start
        start += r["n_tokens"]
    assert write_and_index(no_docs, vocabulary).count() == 0


def test_files_of_bounded_size(spark, vocabulary):
    """Many ranges, also within one doc_id that holds most rows, and the same ids as from one file."""
    rows = [(i if i % 3 else 4, f"text {i} " * 40) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    path = new_path(spark, "test-tokens")
    write_token_files(docs, path, vocabulary, file_bytes=60_000)
    found = read_token_files(spark, path, with_ids=True).collect()
    sizes = {}
    for r in found:
        sizes[r["part"]] = sizes.get(r["part"], 0) + r["n_tokens"]
    assert len(sizes) > 12 and max(sizes.values()) < 4 * sum(sizes.values()) / len(sizes)
    assert sorted((r["doc_id"], r["token_ids"]) for r in found) == sorted((d, [*ids_of(t), 1]) for d, t in rows)
    in_order = sorted(found, key=lambda r: (r["part"], r["local_start"]))
    assert [r["doc_id"] for r in in_order] == sorted(d for d, _ in rows)


@pytest.mark.parametrize("order", ["in turn", "in blocks", "long first"])
def test_no_file_outgrows_its_bound(spark, vocabulary, order):
    """Empty texts and long ones in turn and in blocks: ranges of rows differ in bytes, files stay bounded."""
    long = " ".join(f"w{i % 89}" for i in range(2500))
    place = {"in turn": lambda i: i % 40 == 0, "in blocks": lambda i: i >= 1950, "long first": lambda i: i < 50}[order]
    rows = [(i, long if place(i) else "") for i in range(2000)] + [(5000, long * 30)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    path = new_path(spark, "test-tokens")
    bound = 1 << 17
    write_token_files(docs, path, vocabulary, file_bytes=bound, chunk_ids=1000)
    found = sorted(read_token_files(spark, path, with_ids=True).collect(), key=lambda r: (r["part"], r["local_start"]))
    assert [r["doc_id"] for r in found] == sorted(d for d, _ in rows)
    expected = {t: [*ids_of(t), 1] for t in {t for _, t in rows}}
    assert all(r["token_ids"] == expected[dict(rows)[r["doc_id"]]] for r in found)
    raw = {}
    for r in found:
        raw.setdefault(r["part"], []).append(4 * r["n_tokens"])
    assert len(raw) > 10 and all(sum(v) <= bound or len(v) == 1 for v in raw.values())
    sizes = [r["length"] for r in spark.read.format("binaryFile").load(path).where("length > 0").select("length").collect()]
    assert len(sizes) == len(raw) and max(sizes) <= 2 * bound + 4 * len(expected[long * 30])
    start = 0
    for r in sorted(write_and_index(docs, vocabulary, file_bytes=bound).collect(), key=lambda r: r["doc_id"]):
        assert r["start"] == start
        start += r["n_tokens"]


def test_other_vocabularies_go_through_the_library(tmp_path):
    """Run cuts fit one normaliser and pre-tokenizer; any other vocabulary encodes whole texts."""
    spec = json.load(open(PATH))
    spec["normalizer"]["normalizers"] = spec["normalizer"]["normalizers"][:2]  # without lower case
    (tmp_path / "cased.json").write_text(json.dumps(spec))
    texts = ["It's A Test", "", "Ünï 42<|endoftext|>", "plain"]
    for path in (str(tmp_path / "cased.json"), public_tokenizers.path("byte_bpe_50k.json")):
        other = Tokenizer.from_file(path)
        ids, first = RunBpe.of(path).encode(pa.array(texts, pa.large_string()))
        assert [ids[i:j].tolist() for i, j in zip(first, first[1:])] == [other.encode(t, add_special_tokens=False).ids for t in texts]
    assert RunBpe.of(PATH).by_runs


def test_packing_spreads_equal_rows(spark, vocabulary):
    docs = spark.createDataFrame([(None, "the same words")] * 900 + [(i, f"text {i}") for i in range(100)], "doc_id bigint, text string")
    rows = pack_documents(docs, vocabulary, capacity=64, docs_per_group=50).toPandas()
    per_group = rows.groupby(rows["sequence_id"] // 2**32).size()
    assert len(rows) == 1000 and len(per_group) == 20 and per_group.max() < 100
    assert rows.groupby("sequence_id")["length"].sum().max() <= 64


def test_written_tables_use_small_batches(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "size"])

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    rows = spark.range(0, 5000, 1, 1).selectExpr("id", "repeat('x', if(id = 7, 6000000, 3000)) t")
    seen = written(rows.mapInArrow(sizes, "n long, size long"), "batches").collect()
    assert sum(r.n for r in seen) == 5000 and len(seen) > 3
    assert all(r.size < BATCH_BYTES + 6_100_000 for r in seen) and key not in spark.conf.getAll
    spark.conf.set(key, "1m")
    try:
        assert max(r.size for r in written(rows.where("id != 7").mapInArrow(sizes, "n long, size long"), "batches").collect()) < 1_100_000
        assert spark.conf.get(key) == "1m"
    finally:
        spark.conf.unset(key)
    keyed = rows.groupBy((rows.id % 2).alias("k")).applyInArrow(lambda t: pa.table({"n": [t.num_rows]}), "n long")
    assert sorted(r.n for r in written(keyed, "groups").collect()) == [2500, 2500]
