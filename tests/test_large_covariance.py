"""Covariance in tiles and shares, sums in levels, and leading components of many dimensions, against NumPy."""

import numpy as np
import pyarrow as pa
import pytest

from trajix.operators import over_time


def frames_of(spark, r):
    """r: (frames, atoms, 3)."""
    table = pa.table({"frame": np.arange(len(r)), **{c: pa.array(list(r[:, :, k]), pa.list_(pa.float64())) for k, c in enumerate("xyz")}})
    return spark.createDataFrame(table)


@pytest.mark.parametrize("tile, most_bytes, tasks, fan", [(256, 1 << 28, 3, 64), (8, 8 * 8 * 8 * 3, 7, 2), (5, 1, 20, 3)])
def test_tiles(spark, monkeypatch, tile, most_bytes, tasks, fan):
    monkeypatch.setattr(over_time, "TILE", tile)
    monkeypatch.setattr(over_time, "FAN", fan)
    r = np.cumsum(np.random.default_rng(3).normal(size=(50, 9, 3)), 0) + 1000
    frames = frames_of(spark, r).repartition(tasks)
    own = [0, 2, 3, 8, 5, 6]
    got = {(x["i"], x["j"]): x["value"] for x in over_time.covariance(frames, own, most_bytes).collect()}
    c = np.cov(r[:, own].reshape(50, -1).T)
    assert len(got) == 18 * 19 // 2 and all(got[i, j] == pytest.approx(c[i, j], rel=1e-9, abs=1e-9) for i, j in got)


def test_no_group_holds_more_than_its_fan(spark, monkeypatch):
    monkeypatch.setattr(over_time, "FAN", 4)
    parts = spark.range(60).selectExpr("id % 2 AS key", "id AS task", "array(1.0D, CAST(id AS DOUBLE)) AS v")
    out = over_time._summed(parts, 60)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("FlatMapGroupsInArrow") == 3
    assert {r["key"]: r["v"] for r in out.collect()} == {k: [30.0, float(sum(range(k, 60, 2)))] for k in (0, 1)}


def leading(r, k):
    x = r.reshape(len(r), -1)
    x = x - x.mean(0)
    values, vectors = np.linalg.eigh(x @ x.T / (len(x) - 1))
    return values[::-1][:k], (x.T @ vectors[:, ::-1][:, :k]), (x**2).sum() / (len(x) - 1)


def test_components_of_30000_dimensions(spark):
    rng = np.random.default_rng(5)
    n, atoms = 60, 10_000
    shapes = rng.normal(size=(25, atoms * 3)) / 100
    r = (rng.normal(size=(n, 25)) * np.geomspace(30, 1, 25)) @ shapes + 0.01 * rng.normal(size=(n, atoms * 3)) + 50
    head, loads = over_time.pca(frames_of(spark, r.reshape(n, atoms, 3)).repartition(4), n_components=10)
    values, vectors, whole = leading(r, 10)
    got = head.orderBy("component").toPandas()
    assert np.allclose(got["eigenvalue"], values, rtol=1e-6) and np.allclose(got["variance_ratio"], values / whole, rtol=1e-6)
    found = loads.orderBy("component", "dim").toPandas()["loading"].to_numpy().reshape(10, -1)
    assert np.allclose(np.abs((found @ vectors) / np.linalg.norm(vectors, axis=0)).diagonal(), 1, atol=1e-6)


def test_components_without_gaps(spark, monkeypatch):
    """Values that lie close together, with restarts of a small basis; and more components than the frames have."""
    monkeypatch.setattr(over_time, "MOST_BASIS", 60)
    r = np.random.default_rng(6).normal(size=(400, 100, 3))
    frames = frames_of(spark, r)
    head, _ = over_time.pca(frames, n_components=5)
    assert np.allclose(head.orderBy("component").toPandas()["eigenvalue"], leading(r, 5)[0], rtol=1e-7)
    few = over_time.pca(frames.where("frame < 4"), n_components=8)[0].orderBy("component").toPandas()["eigenvalue"]
    assert np.allclose(few[:3], leading(r[:4], 3)[0], rtol=1e-9) and np.allclose(few[3:], 0, atol=1e-9)
    with pytest.raises(ValueError, match="TooFewFrames"):
        over_time.pca(frames.where("frame < 1"), n_components=2)
