"""Manifests, stripes, bounds and sections of trajectory files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajix.sources import frame_index, trajectories
from trajix.sources.frame_codecs import Window

KINDS = ["xtc", "trr", "nc", "dcd"]


def made(k, n=40, seed=0, box=True):
    rng = np.random.default_rng(seed + k)
    return trajectories.Frame(0.5 * k, 3 * k, [30.0, 0.0, 0.0, 0.0, 31.0, 0.0, 0.0, 0.0, 32.0] if box else None, np.cumsum(rng.normal(size=(n, 3)), 0))


def raw_file(path, kind, frames, n=40):
    codec = trajectories.FORMATS[kind]
    parts = [codec.write(made(k, n)) for k in range(frames)]
    path.write_bytes(codec.head(n, frames) + b"".join(parts))
    return len(codec.head(n, frames)), [len(p) for p in parts]


def table(spark, numbers, traj=None, shift=0.0, extra=()):
    rows = [(traj or "", k, 0.5 * k, 3 * k, None, *(made(k).xyz.T + shift).tolist()) for k in numbers]
    schema = "traj string, frame bigint, time double, step int, box array<double>, x array<double>, y array<double>, z array<double>"
    return spark.createDataFrame(rows, schema)


def written(df, path, kind, **how):
    trajectories.write_trajectory(df.repartitionByRange(3, "traj", "frame").sortWithinPartitions("traj", "frame"), path, kind, **how)


@pytest.mark.parametrize("kind", KINDS)
def test_two_writes_and_two_trajectories(spark, tmp_path, kind):
    path = f"file://{tmp_path}/t"
    written(table(spark, range(6), "a").union(table(spark, range(4), "b", 50.0)), path, kind)
    written(table(spark, range(6, 12), "a").union(table(spark, range(100, 103), "c")), path, kind)
    rows = trajectories.read_trajectory(spark, path).orderBy("traj", "frame").collect()
    assert [(r["traj"], r["frame"]) for r in rows] == [("a", k) for k in range(12)] + [("b", k) for k in range(4)] + [("c", k) for k in range(3)]
    source = [(k, 0.0) for k in range(12)] + [(k, 50.0) for k in range(4)] + [(k, 0.0) for k in range(100, 103)]
    for r, (k, shift) in zip(rows, source):
        assert np.allclose([r[c] for c in "xyz"], made(k).xyz.T + shift, atol=0.006)
        assert kind in ("nc", "dcd") or (r["time"], r["step"]) == (0.5 * k, 3 * k)
    written(table(spark, range(2), "z"), path, kind, mode="overwrite")
    assert [(r["traj"], r["frame"]) for r in trajectories.read_trajectory(spark, path).collect()] == [("z", 0), ("z", 1)]
    assert len([p for p in (tmp_path / "t").iterdir() if p.suffix == f".{kind}"]) <= 2


def test_writes_that_have_no_order(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    with pytest.raises(Exception, match="out of order"):
        trajectories.write_trajectory(table(spark, [3, 1, 2], "a").coalesce(1), path, "trr")
    with pytest.raises(Exception, match="overlap"):
        apart = table(spark, [0, 4, 8, 3, 5], "a").repartitionByRange(2, F.col("frame") % 2).sortWithinPartitions("frame")
        trajectories.write_trajectory(apart, path, "trr")
    assert not (tmp_path / "t").exists() or not [p for p in (tmp_path / "t").rglob("*") if p.is_file()]
    raw_file(tmp_path / "x.trr", "trr", 2)
    (tmp_path / "own").mkdir()
    raw_file(tmp_path / "own" / "x.trr", "trr", 2)
    with pytest.raises(Exception, match="no manifest"):
        written(table(spark, [0]), f"file://{tmp_path}/own", "trr")


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("stripe_bytes", [200, 700, 5000, 1 << 20])
def test_stripes_found_by_executors(spark, tmp_path, kind, stripe_bytes):
    """Whatever the ranges, the stripes hold each frame once; bytes of a cut frame at the end belong to none."""
    _, sizes = raw_file(tmp_path / f"x.{kind}", kind, 23)
    path = f"{tmp_path}/x.{kind}"
    if kind in ("xtc", "trr"):
        with open(path, "ab") as f:
            f.write(trajectories.FORMATS[kind].write(made(0))[:100])
    stripes = frame_index.find_stripes(spark, [("t", path), ("u", path)], stripe_bytes)
    for traj in "tu":
        own = [s for s in stripes if s.traj == traj]
        assert sum(s.n for s in own) == 23 and own[0].begin == 0 and own[-1].end == sum(sizes)
        assert all(a.end == b.begin for a, b in zip(own, own[1:])) and (len(own) > 3) == (stripe_bytes < 5000)
    index = trajectories.index_trajectories(spark, path, f"file://{tmp_path}/index.parquet", stripe_bytes)
    got = trajectories.read_trajectory(spark, path, index=index).orderBy("frame").collect()
    assert [r["frame"] for r in got] == list(range(23)) and all(np.allclose([r[c] for c in "xyz"], made(k).xyz.T, atol=0.006) for k, r in enumerate(got))


def test_what_looks_like_a_frame(spark, tmp_path):
    """Coordinates that spell headers, and frames of unlike sizes, are told apart by reading on from the frame before."""
    fake = trajectories.Xtc.write(made(5, 3))
    codec, parts = trajectories.Xtc, []
    for k in range(30):
        body = codec.write(made(k, 9 if k % 3 else 200))
        if k % 3 == 0:  # the compressed block holds whole frames of nine atoms
            head, block = bytearray(body[:92]), codec.write(made(1, 9)) * 3 + fake
            head[88:92] = len(block).to_bytes(4, "big")
            body = bytes(head) + block
        parts.append(body)
    (tmp_path / "x.xtc").write_bytes(b"".join(parts))
    for size in (100, 333, 4096):
        stripes = frame_index.find_stripes(spark, [("t", f"{tmp_path}/x.xtc")], size)
        assert sum(s.n for s in stripes) == 30 and stripes[-1].end == sum(map(len, parts)) and all(a.end == b.begin for a, b in zip(stripes, stripes[1:]))


@pytest.mark.parametrize("kind", KINDS)
def test_bounds_read_only_their_bytes(spark, tmp_path, monkeypatch, kind):
    n, frames = 5000, 40
    _, sizes = raw_file(tmp_path / f"x.{kind}", kind, frames, n)
    path = f"{tmp_path}/x.{kind}"
    index = trajectories.index_trajectories(spark, path, f"file://{tmp_path}/i.parquet", 4 * max(sizes))
    taken = []

    class Counted(Window):
        def __exit__(self, *_):
            taken.append(self.taken)
            super().__exit__()

    def opened(path, block=0, limit=1 << 62):
        return Counted(open_file(path), block, limit)

    def open_file(path):
        import pyarrow.fs as fs

        return fs.LocalFileSystem().open_input_file(path)

    monkeypatch.setattr(trajectories, "opened", opened)

    def run(names, **bounds):
        taken.clear()
        reader = trajectories._Reader({"path": path, "index": index, **bounds}, names)
        return [r["frame"] for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()], sum(taken)

    names = ["frame", "time", "x", "y", "z"]
    head = 1 << 16 if kind == "nc" else 1 << 10  # of a file, read for each stripe
    numbers, everything = run(names)
    assert numbers == list(range(frames)) and everything >= sum(sizes)
    numbers, some = run(names, frames="18,21")
    assert numbers == [18, 19, 20, 21] and some < 5 * max(sizes) + 4 * head
    numbers, one = run(names, frames="30,30")
    assert numbers == [30] and one < 2 * max(sizes) + head
    numbers, times = run(names, times="9.0,10.0")
    if kind in ("xtc", "trr"):
        assert numbers == [18, 19, 20] and times < 4 * max(sizes) + 2 * head
    numbers, heads = run(["frame", "time", "step"])
    assert numbers == list(range(frames)) and heads < frames * 400 + 12 * head
    assert run(names, frames="100,") == ([], 0) and run(names, frames=",1")[0] == [0, 1]


def test_bounds_of_a_query(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    written(table(spark, range(60), "a").union(table(spark, range(60), "b")), path, "xtc")
    some = trajectories.read_trajectory(spark, path, frames=(10, 12), times=(None, 5.9))
    assert [(r["traj"], r["frame"]) for r in some.where("traj = 'b'").orderBy("frame").collect()] == [("b", 10), ("b", 11)]
    frames = trajectories.read_trajectory(spark, path)
    assert frames.where("frame between 10 and 12 and traj = 'b' and time < 5.9").count() == 2
    assert frames.where("frame in (3, 50) or time = 1.5").count() == 4  # over the same DataFrame as the query before
    assert frames.where("frame = 0").join(frames.where("frame = 1"), "traj").count() == 2
    times = {r["traj"]: tuple(r)[1:] for r in trajectories.trajectory_times(spark, path).collect()}
    assert times == {"a": (60, 0.0, 29.5), "b": (60, 0.0, 29.5)}


@pytest.mark.parametrize("double", [False, True])
def test_velocities_and_forces(spark, tmp_path, double):
    rng = np.random.default_rng(0)
    rows = [("", k, 0.1 * k, k, [20.0, 0.0, 0.0, 0.0, 21.0, 0.0, 0.0, 0.0, 22.0], *(rng.normal(size=(9, 5)) * 7).tolist()) for k in range(6)]
    rows[2] = (*rows[2][:8], None, None, None, *rows[2][11:])
    names = [*"xyz", "vx", "vy", "vz", "fx", "fy", "fz"]
    schema = "traj string, frame bigint, time double, step int, box array<double>, " + ", ".join(f"{c} array<double>" for c in names)
    path = f"file://{tmp_path}/t"
    trajectories.write_trajectory(spark.createDataFrame(rows, schema).coalesce(1), path, "trr", double=double)
    got = trajectories.read_trajectory(spark, path, sections=("velocities", "forces")).orderBy("frame").collect()
    for a, b in zip(rows, got):
        for value, c in zip(a[5:], names):
            assert (value is None and b[c] is None) or np.allclose(value, b[c], rtol=1e-14 if double else 1e-6, atol=0)
        assert (b["time"] == a[2] or not double) and np.allclose(b["box"], a[4], rtol=1e-6)
    assert trajectories.read_trajectory(spark, path).columns[-3:] == list("xyz")
    some = trajectories.read_trajectory(spark, path, ["frame", "vy"], ("velocities",)).orderBy("frame").collect()
    assert [r["vy"] is None for r in some] == [False, False, True, False, False, False]
    sizes = {d: sum(p.stat().st_size for p in (tmp_path / "t").glob("*.trr")) for d in [double]}
    assert sizes[double] > 6 * (3 * 3 * 5 * (8 if double else 4)) - 3 * 5 * 8
    with pytest.raises(Exception, match="InvalidAtomCount"):
        bad = spark.createDataFrame([(0, [1.0] * 3, [1.0] * 3, [1.0] * 3, [1.0], [1.0], [1.0])], "frame bigint, x array<double>, y array<double>, z array<double>, vx array<double>, vy array<double>, vz array<double>")
        trajectories.write_trajectory(bad, f"file://{tmp_path}/u", "trr")


def test_folder_of_foreign_files(spark, tmp_path):
    """Files that no manifest lists are one trajectory by name; the plain format finds the same frames alone."""
    for k, name in enumerate("ab"):
        raw_file(tmp_path / f"{name}.xtc", "xtc", 4 + k)
    got = trajectories.read_trajectory(spark, str(tmp_path)).agg(F.count("*"), F.max("frame"), F.count_distinct("traj")).first()
    assert tuple(got) == (9, 8, 1)
    assert spark.read.format("trajectory").load(f"{tmp_path}/*.xtc").groupBy("traj").count().count() == 2
