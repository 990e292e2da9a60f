"""Near pairs found in the task that reads a frame: against all pairs, on large frames, and without a shuffle."""

import numpy as np
import pyarrow as pa
import pytest

from trajix.functions.points import pairs_between
from trajix.model import ATOMS, BONDS, CHAINS, RESIDUES, Topology
from trajix.operators import derived, spatial
from trajix.plans import sample


def all_pairs(p, pg, q, qg, cutoff, inclusive=False):
    d = np.sqrt(((p[:, None] - q[None]) ** 2).sum(2))
    near = (pg[:, None] == qg[None]) & (d <= cutoff if inclusive else d < cutoff)
    return set(zip(*(x.tolist() for x in np.nonzero(near))))


@pytest.mark.parametrize("cutoff", [0.0, 0.7, 3.0, 50.0])
def test_pairs_of_two_sets(monkeypatch, cutoff):
    from trajix.functions import points

    rng = np.random.default_rng(8)
    p, q = rng.normal(size=(200, 3)) * 4, np.concatenate([rng.normal(size=(150, 3)) * 4, [[1e9, 0, 0], [np.nan, 0, 0], [np.inf, 1, 1]]])
    q[:5] = p[:5]
    pg, qg = rng.integers(0, 3, 200), rng.integers(0, 3, 153)
    qg[:5] = pg[:5]
    for step in (1 << 21, 7):
        monkeypatch.setattr(points, "STEP_PAIRS", step)
        for inclusive in (False, True):
            found = [(a, b) for x in pairs_between(p, pg, q, qg, cutoff, inclusive) for a, b in zip(x[0].tolist(), x[1].tolist())]
            with np.errstate(invalid="ignore"):
                assert len(found) == len(set(found)) and set(found) == all_pairs(p, pg, q, qg, cutoff, inclusive)
    assert list(pairs_between(p[:0], pg[:0], q, qg, 1.0)) == []


def frames_of(spark, r):
    return spark.createDataFrame(pa.table({"frame": np.arange(len(r)), **{c: pa.array(list(r[:, :, k]), pa.list_(pa.float64())) for k, c in enumerate("xyz")}}))


def test_frames_of_20000_atoms(spark):
    """Neighbours, contacts, hydrogen bonds, g(r), lists and native contacts of two large frames, against NumPy over blocks of all pairs."""
    rng, n = np.random.default_rng(2), 20_000
    r = np.sort(rng.uniform(0, 62, size=(2, n, 3)), axis=1)[:, rng.permutation(n)]
    r = rng.uniform(0, 62, size=(2, n, 3))
    frames = frames_of(spark, r)
    residues, element = np.arange(n) // 10, rng.choice([1, 6, 7, 8], n)
    i_all, j_all, d_all = [], [], []
    for at in range(0, n, 500):
        d = np.sqrt(((r[0, at : at + 500, None] - r[0, None]) ** 2).sum(2))
        a, b = np.nonzero(d <= 3.0)
        i_all.append(a + at), j_all.append(b), d_all.append(d[a, b])
    i, j, d = (np.concatenate(x) for x in (i_all, j_all, d_all))
    once = i < j
    got = spatial.neighbours(frames, 3.0).where("frame = 0").toPandas().sort_values(["i", "j"])
    order = np.lexsort((j[once], i[once]))
    assert (got["i"].to_numpy() == i[once][order]).all() and (got["j"].to_numpy() == j[once][order]).all() and np.allclose(got["d"], d[once][order])
    best = {}
    for a, b, x in zip(residues[i].tolist(), residues[j].tolist(), d.tolist()):
        if a < b:
            best[a, b] = min(x, best.get((a, b), 9.0))
    table = spark.createDataFrame([(k, int(residues[k]), "X", int(element[k])) for k in range(n)], "atom_index int, residue_index int, name string, element int")
    found = {(x["residue_i"], x["residue_j"]): x["distance"] for x in spatial.contacts(frames, table, "closest", 3.0).where("frame = 0").collect()}
    assert found.keys() == best.keys() and all(found[k] == pytest.approx(best[k]) for k in best)
    shells = spatial.rdf(frames, list(range(n)), list(range(n)), 62.0**3, 0.0, 3.0, 6).where("frame = 0").orderBy("bin").toPandas()["g_r"]
    low = np.arange(6) * 0.5
    expected = np.histogram(d[d < 3.0], bins=6, range=(0, 3))[0] / (n / 62.0**3 * n * 4 / 3 * np.pi * ((low + 0.5) ** 3 - low**3))
    assert np.allclose(shells, expected)
    atoms = {k: 1.0 + 0.2 * (k % 3) for k in range(0, n, 2)}
    lists = spatial.neighbour_lists(frames, atoms, {k: 0.9 for k in range(1, n, 3)}, 0.1).where("frame = 0").first()
    wanted = {}
    for a, b, x in zip(i.tolist(), j.tolist(), d.tolist()):
        if a in atoms and b % 3 == 1 and a != b and x < atoms[a] + 0.9 + 0.2:
            wanted.setdefault(a, []).append((x, b))
    assert lists["atoms"] == sorted(atoms) and lists["offsets"][-1] == len(lists["members"]) == sum(map(len, wanted.values()))
    for k, a in enumerate(lists["atoms"]):
        assert lists["members"][lists["offsets"][k] : lists["offsets"][k + 1]] == [b for _, b in sorted(wanted.get(a, []))]
    a = list(range(0, n, 7))
    q = {x["frame"]: x["value"] for x in spatial.native_contacts(frames, tuple(r[0].T), a, list(range(n)), 2.0).collect()}
    own = (i % 7 == 0) & (d <= 2.0)
    assert q[0] == 1.0 and q[1] == pytest.approx((np.sqrt(((r[1, i[own]] - r[1, j[own]]) ** 2).sum(1)) <= 2.0).mean())
    topology = Topology(
        spark.createDataFrame([(k, "X", int(element[k]), int(residues[k]), None, None) for k in range(n)], ATOMS),
        spark.createDataFrame([(k, "ALA", k, 0) for k in range(n // 10)], RESIDUES), spark.createDataFrame([(0, "A")], CHAINS), spark.createDataFrame([], BONDS),
    )
    arms = {}
    for a, b, x in sorted(zip(i.tolist(), j.tolist(), d.tolist()), key=lambda t: (t[0], t[2], t[1])):
        if element[a] == 1 and element[b] in (7, 8) and x < 1.3:
            arms.setdefault(a, b)
    bonds = set()
    for a, b, x in zip(i.tolist(), j.tolist(), d.tolist()):
        if a in arms and element[b] in (7, 8) and b != arms[a] and x <= 2.5:
            u, v = r[0, arms[a]] - r[0, a], r[0, b] - r[0, a]
            if np.degrees(np.arccos(np.clip(u @ v / np.linalg.norm(u) / np.linalg.norm(v), -1, 1))) >= 120:
                bonds.add((arms[a], a, b))
    got = spatial.hydrogen_bonds(frames, topology).where("frame = 0").collect()
    assert len(got) == len(bonds) > 50 and {(x["donor"], x["hydrogen"], x["acceptor"]) for x in got} == bonds
    assert spatial.hydrogen_bond_counts(frames, topology).where("frame = 0").first()["n_hbonds"] == len(bonds)


def test_no_row_moves(spark, tables):
    frames, t = sample.frames(spark, tables), sample.topology(spark)
    plans = [
        spatial.neighbours(frames, 3.0), spatial.neighbours_by_radius(frames, [1.5] * 21, 0.1), spatial.contacts(frames, t.table()), spatial.hydrogen_bonds(frames, t),
        spatial.hydrogen_bond_counts(frames, t), spatial.rdf(frames, [0], [1, 2], 100.0), spatial.native_contacts(frames, ([0.0] * 21,) * 3, [0], [1]),
        spatial.infer_donor_hydrogens(frames, t), derived.analyze_all(frames, t), spatial.neighbour_lists(frames, {0: 1.0}),
    ]
    for df in plans:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" not in plan and plan.count("MapInArrow") == 1, plan


def test_join_by_cells_sends_no_repeated_rows_to_the_driver(spark):
    """Points on and beside edges of cells, far ones and none: the pairs of all pairs, by a plan without a broadcast, eight rows to a point at most."""
    rng = np.random.default_rng(4)
    r = np.concatenate([rng.normal(size=(60, 3)) * 5, rng.integers(-3, 4, size=(60, 3)) * 3.0, rng.integers(-3, 4, size=(20, 3)) * 6.000000012])
    r = np.concatenate([r, [[1e300, 0, 0], [np.inf, 1, 1], [-np.inf, 1, 1], [np.nan, 0, 0]]])
    rows = spark.createDataFrame([(0, i, *p) for i, p in enumerate(r.tolist())] + [(None, 0, 0.0, 0.0, 0.0), (0, 999, None, 0.0, 0.0)], "frame bigint, atom_index int, x double, y double, z double")
    group = np.zeros(len(r), int)
    for inclusive in (False, True):
        found = spatial.near_pairs(rows, rows, 3.0, True, inclusive)
        got = [(x["atom_index"], x["atom_index_b"]) for x in found.where("frame is not null").collect()]
        with np.errstate(invalid="ignore"):
            assert len(got) == len(set(got)) and set(got) == all_pairs(r, group, r, group, 3.0, inclusive)
        assert found.where("frame is null").count() == 1
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastExchange" not in plan and "SortMergeJoin" in plan
