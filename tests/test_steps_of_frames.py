"""A task's arrays grow with neither the frames of a batch nor those of a table."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from trajix.elements import RADII
from trajix.functions.points import runs
from trajix.operators import dssp, sasa
from trajix.plans import sample


def batch_of(r):
    return pa.record_batch({c: pa.array(list(r[:, :, k]), pa.list_(pa.float64())) for k, c in enumerate("xyz")})


def folded_work():
    own = {}
    for i, a in enumerate(sample.FOLDED):
        own.setdefault(a[3], {"residue": a[3], "chain": a[5], "pro": a[4] == "PRO"})[{"N": "n", "CA": "a", "C": "c", "O": "o"}[a[1]]] = i
    at, _, chain, pro = dssp._of_residues([r for _, r in sorted(own.items()) if "c" in r])
    return lambda points: dssp._bonding(points, at, chain, pro)


@pytest.mark.parametrize("name", ["folded", "areas"])
def test_memory_of_a_step(name):
    """Under 64 MB beside the batch; in one step, secondary structure took 218 MB and surface areas 254."""
    rng = np.random.default_rng(3)
    if name == "folded":
        r, work = np.array([a[6:9] for a in sample.FOLDED]) + rng.normal(size=(1600, len(sample.FOLDED), 3)) * 0.3, folded_work()
    else:
        radii = [RADII[a[2]] for a in sample.MAIN]
        r, work = rng.normal(size=(10_000, 21, 3)) * 2.5, lambda p: sasa.areas_of(p, radii, None, 1.4, 100)
    batch = batch_of(r)
    n = 0
    tracemalloc.start()
    try:
        for at, end, points in runs(batch):
            work(points)
            n += end - at
        peak = tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()
    assert n == len(r) and peak < 64, peak


@pytest.mark.parametrize("prefer_pi", [True, False])
@pytest.mark.parametrize("name", ["crowded", "one point"])
def test_memory_of_a_step_of_crowded_frames(monkeypatch, name, prefer_pi):
    """Codes of frames whose residues are all near each other: under 100 MB, where all pairs at once took 223 MB and 907."""
    if name == "crowded":
        atoms = [a[6:9] for a in sample.FOLDED if a[3] < 84]
        m, r = len(atoms) // 4, np.array(atoms) * 0.1 + np.random.default_rng(3).normal(size=(192, len(atoms), 3))
    else:
        m, r = 2000, np.zeros((1, 8000, 3))
    residues = [{"residue": i, "chain": 0, "pro": False, **{p: 4 * i + k for k, p in enumerate("naco")}} for i in range(m)]
    works = []
    monkeypatch.setattr(dssp, "complete_residues", lambda table: residues)
    monkeypatch.setattr(dssp, "rows_of_frames", lambda frames, columns, work: works.append(work))
    dssp.dssp(None, None, prefer_pi)
    tracemalloc.start()
    try:
        rows = sum(len(owner) for owner, _ in works[0](r))
        peak = tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()
    assert rows == m * len(r) and peak < 100, peak


@pytest.mark.parametrize("scale", [0.3, 1.0])
def test_bridges_of_pairs_beside_bonds(scale):
    """Codes, sheets and strands of the near pairs that bonds could make a bridge of are those of all near pairs."""
    own = {}
    for i, a in enumerate(sample.FOLDED):
        own.setdefault(a[3], {"residue": a[3], "chain": a[5], "pro": a[4] == "PRO"})[{"N": "n", "CA": "a", "C": "c", "O": "o"}[a[1]]] = i
    at, _, chain, pro = dssp._of_residues([r for _, r in sorted(own.items()) if "c" in r])
    points = np.array([a[6:9] for a in sample.FOLDED]) + np.random.default_rng(5).normal(size=(300, len(sample.FOLDED), 3)) * scale
    x, alone = dssp._bonding(points, at, chain, pro), dssp._bonding(points, at, chain, pro, every=False)
    assert len(x.donor) and not len(alone.donor) and all((v == alone.best[k]).all() for k, v in x.best.items())
    once = x.donor < x.acceptor
    strong = x.best["energy"] < dssp.BOND_BELOW
    bonds = x.best["donor"][strong], x.best["acceptor"][strong]
    angles = [x.angles[a] for a in ("kappa", "phi", "psi")]
    few = dssp._facing(bonds, points[:, at["a"]])
    expected = dssp.assign_frames(chain, x.segment, bonds, (x.donor[once], x.acceptor[once]), *angles)
    found = dssp.assign_frames(chain, x.segment, bonds, few, *angles)
    assert 0 < len(few[0]) < once.sum() and (expected[1] > 0).any()
    assert all((a == b).all() for a, b in zip(expected, found))


def test_every_residue_reads_its_frames_once(spark, tables):
    """One plan of the frames, not one for their numbers and one for their codes; residues of a frame without any are blank."""
    found = spark.createDataFrame([(1, 0, "H"), (1, 2, None), (2, 9, "E"), (None, 1, "G")], "frame bigint, residue_index int, code string")
    topology = spark.createDataFrame([(i,) for i in (0, 1, 1, 2)], "residue_index int")
    rows = dssp.every_residue(found, topology)
    codes = {1: "H  ", 2: "   ", None: " G "}
    assert sorted(map(tuple, rows.collect()), key=repr) == sorted([(f, i, c) for f, own in codes.items() for i, c in enumerate(own)], key=repr)
    folded = dssp.dssp(sample.folded_frames(spark, tables), sample.folded_topology(spark).table())
    plan = dssp.every_residue(folded, sample.folded_topology(spark).table())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan
