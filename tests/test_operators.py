"""Operators on small systems whose results are known by hand."""

from math import cos, pi, sin, sqrt

import pytest
from pyspark.sql import functions as F

from trajix.elements import RADII, element_of
from trajix.model import ATOMS, BONDS, CHAINS, RESIDUES, Topology, check_atom_count, to_long, to_wide
from trajix.operators import derived, dssp, frame_sums, geometry, over_time, pbc, sasa, selection, spatial, superposition

FRAME = "frame bigint, x array<double>, y array<double>, z array<double>"


def frames(spark, *points):
    return spark.createDataFrame([(k, *[list(map(float, a)) for a in zip(*p)]) for k, p in enumerate(points)], FRAME)


def topology(spark, atoms, residues, bonds=()):
    """atoms: (name, element, residue); residues: (name, chain)."""
    return Topology(
        spark.createDataFrame([(i, n, e, r, None, None) for i, (n, e, r) in enumerate(atoms)], ATOMS),
        spark.createDataFrame([(i, n, i + 1, c) for i, (n, c) in enumerate(residues)], RESIDUES),
        spark.createDataFrame([(c, "A") for c in sorted({c for _, c in residues})], CHAINS),
        spark.createDataFrame(list(bonds), BONDS),
    )


def values(df, order, column="value"):
    return [r[column] for r in df.orderBy(order).collect()]


def test_elements():
    assert [element_of(s) for s in ("C", "ca", " Cl ", "Qx", "", None, "Ha", "C1")] == [6, 20, 17, 0, 0, None or 0, 1, 6]


def test_tuple_geometry(spark):
    f = frames(spark, [(0, 0, 0), (3, 4, 0), (1, 0, 0), (0, 0, 1)], [(1, 0, 0), (1, 0, 0), (0, 0, 0), (0, 1, 0)])
    assert values(geometry.distances(f, [(0, 1)]), "frame") == [5.0, 0.0]
    right = geometry.angles(f, [(2, 0, 3)]).where("frame = 0").first()["value"]
    assert right == pytest.approx(pi / 2)
    assert geometry.angles(f, [(0, 1, 2)]).where("frame = 1").first()["value"] is None  # an arm without length


@pytest.mark.parametrize("turn", [0.0, pi / 2, -pi / 3, 2.5])
def test_dihedral(spark, turn):
    f = frames(spark, [(1, 0, 0), (0, 0, 0), (0, 0, 1), (cos(turn), sin(turn), 1)])
    assert geometry.dihedrals(f, [(0, 1, 2, 3)]).first()["value"] == pytest.approx(turn)


def test_torsions_stop_at_chains_and_missing_atoms(spark):
    t = topology(spark, [("N", 7, 0), ("CA", 6, 0), ("C", 6, 0), ("N", 7, 1), ("CA", 6, 1), ("C", 6, 1), ("N", 7, 2), ("CA", 6, 2)], [("ALA", 0), ("GLY", 0), ("SER", 1)])
    f = frames(spark, [(i, i * i % 3, i % 2) for i in range(8)])
    phi, psi = (values(geometry.torsions(f, t.table(), k), "residue_index") for k in ("phi", "psi"))
    assert [v is None for v in phi] == [True, False, True]
    assert [v is None for v in psi] == [False, True, True]
    with pytest.raises(ValueError):
        geometry.torsion_atoms(t.table(), 5)


def test_selection_language(spark):
    assert selection.parse_ranges(" 5-10, 0,1,,7 ") == [(0, 1), (5, 10)]
    for bad in ("a", "5-3", "1-2-3"):
        with pytest.raises(selection.InvalidSpec):
            selection.parse_ranges(bad)
    assert selection.parse_tuples("0-1,2-3", 2) == [(0, 1), (2, 3)]
    with pytest.raises(selection.InvalidSpec):
        selection.parse_tuples("0-1-2", 2)
    with pytest.raises(IndexError):
        selection.check_indices([3], 3)
    t = topology(spark, [("N", 7, 0), ("CA", 6, 0), ("O", 8, 1), ("CA", 6, 2)], [("GLY", 0), ("HOH", 0), ("MSE", 0)]).table()
    assert selection.indices(t, "backbone") == [0, 1]
    assert selection.indices(t, "water") == [2]
    assert selection.indices(t, "name CA") == selection.indices(t, "CA") == [1, 3]
    assert selection.indices(t, "index 2-9") == [2, 3]
    assert selection.indices(t, None) is None
    with pytest.raises(selection.EmptySelection):
        selection.indices(t, "name XX")


def test_topology_problems(spark):
    good = topology(spark, [("N", 7, 0)], [("GLY", 0)])
    assert good.validate().count() == 0
    bad = topology(spark, [("N", 7, 3)], [("GLY", 0)], [(0, 9)])
    assert {(r["problem"], r["id"]) for r in bad.validate().collect()} == {("atom without residue", 3), ("bond without atom", 9)}


def test_frame_sums(spark):
    f = frames(spark, [(1000, 0, 0), (1002, 0, 0)])
    assert frame_sums.radius_of_gyration(f, [1.0, 1.0]).first()["value"] == pytest.approx(1)
    assert frame_sums.radius_of_gyration(f, [1.0, 1.0], [0]).first()["value"] == 0
    assert tuple(frame_sums.center(f, [3.0, 1.0]).first())[1:] == pytest.approx((1000.5, 0, 0))
    assert tuple(frame_sums.center(f, [0.0, 0.0]).first())[1:] == (0, 0, 0)
    assert tuple(frame_sums.center(f, None, []).first())[1:] == (0, 0, 0)
    i = frame_sums.inertia(f, [1.0, 1.0])
    assert tuple(i.first())[1:] == pytest.approx((0, 2, 2, 0, 0, 0))
    assert tuple(frame_sums.principal_moments(i).first())[1:] == pytest.approx((0, 2, 2))


def test_superposition(spark):
    base = [(0, 0, 0), (1, 0, 0), (0, 2, 0), (0, 0, 3)]
    turned = [(y + 5, -x, z) for x, y, z in base]
    mirrored = [(-x, y, z) for x, y, z in base]
    f = frames(spark, base, turned, mirrored)
    ref = superposition.reference_of(f, 0)
    found = values(superposition.rmsd(f, ref), "frame")
    assert found[:2] == pytest.approx([0, 0], abs=1e-6)
    assert found[2] > 0.1
    moved = superposition.superpose(f, ref)
    assert values(moved, "frame", "rmsd") == pytest.approx(found, abs=1e-6)
    assert moved.where("frame = 1").first()["y"] == pytest.approx([p[1] for p in base], abs=1e-9)
    assert values(superposition.rmsd(f, ref, []), "frame") == [0, 0, 0]


def test_over_time(spark):
    f = frames(spark, *[[(t, 0, 0), (0, (-1) ** t, 0)] for t in range(4)])
    assert values(over_time.msd(f, [0]), "lag") == pytest.approx([0, 1, 4, 9])
    assert values(over_time.rmsf(f), "atom_index") == pytest.approx([sqrt(1.25), 1])
    c = {(r["i"], r["j"]): r["value"] for r in over_time.covariance(f, [0]).collect()}
    assert c[0, 0] == pytest.approx(5 / 3) and c[1, 1] == c[0, 2] == pytest.approx(0)
    with pytest.raises(ValueError):
        over_time.covariance(f.where("frame = 0"))
    with pytest.raises(ValueError):
        over_time.rmsf(f.where("frame > 9"))


def test_cells_and_plain_joins_agree(spark, tables):
    from trajix.plans import sample

    long = to_long(sample.frames(spark, tables).where("frame < 20"))
    found = [spatial.near_pairs(long, long, 4.0, cells).select("frame", "atom_index", "atom_index_b").distinct().count() for cells in (True, False)]
    assert found[0] == found[1] > 0


def test_hydrogen_bonds(spark):
    atoms, residues = [("N", 7, 0), ("H", 1, 0), ("O", 8, 1)], [("GLY", 0), ("GLY", 0)]
    line, far, bent = ([(0, 0, 0), (1, 0, 0), p] for p in ((3.5, 0, 0), (3.6, 0, 0), (1, 2, 0)))
    for bonds in ([(0, 1)], []):  # without bonds, the hydrogen finds its donor
        found = spatial.hydrogen_bonds(frames(spark, line, far, bent), topology(spark, atoms, residues, bonds))
        assert [(r["frame"], r["donor"], r["hydrogen"], r["acceptor"]) for r in found.collect()] == [(0, 0, 1, 2)]
        assert found.first()["angle"] == pytest.approx(180)
    f = frames(spark, line, far)
    assert values(spatial.counts_by_frame(f, found, "n"), "frame", "n") == [1, 0]


def test_contacts(spark):
    t = topology(spark, [("CA", 6, 0), ("H", 1, 0), ("CA", 6, 1), ("N", 7, 2)], [("GLY", 0)] * 3).table()
    f = frames(spark, [(0, 0, 0), (2, 0, 0), (4, 0, 0), (4, 3, 0)])
    pairs = lambda scheme, cutoff: {(r["residue_i"], r["residue_j"]): r["distance"] for r in spatial.contacts(f, t, scheme, cutoff).collect()}
    assert pairs("closest", 3.5) == {(0, 1): 2.0, (1, 2): 3.0}
    assert pairs("closest", 2.0) == {}
    assert pairs("closest_heavy", 3.5) == {(1, 2): 3.0}
    assert pairs("ca", 4.5) == {(0, 1): 4.0}


def test_rdf_counts_itself_and_normalises(spark):
    f = frames(spark, [(0, 0, 0), (1.5, 0, 0)])
    g = values(spatial.rdf(f, [0], [0, 1], 100.0, 0.0, 3.0, 3), "bin", "g_r")
    shell = lambda k: 4 / 3 * pi * ((k + 1) ** 3 - k**3)
    assert g == pytest.approx([1 / (0.02 * shell(0)), 1 / (0.02 * shell(1)), 0])


def test_native_contacts(spark):
    f = frames(spark, [(0, 0, 0), (3, 0, 0)], [(0, 0, 0), (9, 0, 0)])
    ref = superposition.reference_of(f, 0)
    assert values(spatial.native_contacts(f, ref, [0], [1], 4.5), "frame") == [1, 0]
    assert values(spatial.native_contacts(f, ref, [0], [1], 1.0), "frame") == [0, 0]
    soft = values(spatial.native_contacts(f, ref, [0], [1], 4.5, beta=5.0), "frame")
    assert soft[0] > 0.99 and soft[1] < 0.01


def test_boxes(spark):
    box = [10.0, 0, 0, 0, 10.0, 0, 0, 0, 10.0]
    f = frames(spark, [(-1, 11, 25), (9.5, 0, 0), (0.5, 0, 0)])
    r = pbc.wrap(to_long(f), box).where("atom_index = 0").first()
    assert (r["x"], r["y"], r["z"]) == (9, 1, 5)
    assert pbc.image_distances(f, [(1, 2)], box).first()["value"] == pytest.approx(1)
    assert pbc.make_whole(f, [(1, 2)], 3, box).first()["x"] == pytest.approx([-1, 9.5, 10.5])
    assert pbc.make_whole(f, [], 3, box).first()["x"] == [-1, 9.5, 0.5]
    assert pbc.is_orthorhombic(box) and not pbc.is_orthorhombic([10.0, 0, 0, 1, 10.0, 0, 0, 0, 10.0])
    with pytest.raises(ValueError):
        pbc.wrap(to_long(f), [0.0] * 9)
    volume = spatial.box_volume(f.selectExpr("*", "array(10D,0D,0D,0D,10D,0D,0D,0D,10D) AS box"))
    assert volume.first()["volume"] == pytest.approx(1000)


def test_sasa(spark):
    one, two = frames(spark, [(0, 0, 0)]), frames(spark, [(0, 0, 0), (1.5, 0, 0)])
    whole = 4 * pi * (1.7 + 1.4) ** 2
    assert sasa.sasa(one, [RADII[6]]).first()["area"] == pytest.approx(whole)
    assert whole < sasa.total(sasa.sasa(two, [RADII[6]] * 2)).first()["area"] < 2 * whole


def test_layouts_and_guards(spark):
    f = frames(spark, [(1, 2, 3), (4, 5, 6)])
    assert to_wide(to_long(f)).first() == f.first()
    assert check_atom_count(f, 2).count() == 1
    with pytest.raises(Exception, match="InvalidAtomCount"):
        check_atom_count(f, 3).collect()
    assert derived.every_nth(f, 2).count() == 1
    assert derived.trajectory_info(f.selectExpr("*", "2.5D AS time")).first()["first_time"] == 2.5


def test_trajectories_stay_apart(spark):
    """Two trajectories in one table, with the same frame numbers, one of them without a name."""
    rows = [(t, k, [float(k * v)], [0.0], [0.0]) for t, v, n in (("a", 1, 4), ("b", 10, 3), (None, 2, 2)) for k in range(n)]
    f = spark.createDataFrame(rows, "traj string, " + FRAME)
    got = {(r["traj"], r["lag"]): r["value"] for r in over_time.msd(f).collect()}
    assert got == pytest.approx({**{("a", k): float(k * k) for k in range(4)}, **{("b", k): 100.0 * k * k for k in range(3)}, (None, 0): 0.0, (None, 1): 4.0})
    spread = {r["traj"]: r["value"] for r in over_time.rmsf(f).collect()}
    assert spread == pytest.approx({"a": sqrt(1.25), "b": 10 * sqrt(2 / 3), None: 1.0})
    assert sorted(map(repr, to_wide(to_long(f)).collect())) == sorted(map(repr, f.collect()))
    assert {(r["traj"], r["frame"]): r["cx"] for r in frame_sums.center(f, [2.0]).collect()}["b", 2] == 20.0


BOX_OF_ITS_OWN = FRAME + ", box array<double>"


def test_boxes_of_their_own(spark):
    cube = lambda v: [v, 0.0, 0.0, 0.0, v, 0.0, 0.0, 0.0, v]
    xyz = [0.5, 9.5], [0.0, 0.0], [0.0, 0.0]
    f = spark.createDataFrame([(0, *xyz, cube(10.0)), (1, *xyz, cube(6.0))], BOX_OF_ITS_OWN)
    assert values(pbc.image_distances(f, [(0, 1)]), "frame") == pytest.approx([1, 3])
    assert values(pbc.wrap(to_long(f, keep=("box",))).where("atom_index = 1"), "frame", "x") == pytest.approx([9.5, 3.5])
    assert [r["x"] for r in pbc.make_whole(f, [(0, 1)], 2).orderBy("frame").collect()] == [pytest.approx([0.5, -0.5]), pytest.approx([0.5, -2.5])]
    g = [r["g_r"] for r in spatial.rdf(f, [0], [0], None, 0.0, 1.0, 1).orderBy("frame").collect()]
    assert g[0] / g[1] == pytest.approx(1000 / 216)
    skewed = [10.0, 0.0, 0.0, 4.0, 9.0, 0.0, -3.0, 2.0, 8.0]
    fixed, own = (pbc.make_whole(x, [(0, 1)], 2, b).first()["x"] for x, b in ((f.where("frame = 0"), skewed), (f.where("frame = 0").withColumn("box", F.lit(skewed)), None)))
    assert fixed == pytest.approx(own)
    for bad in (None, [0.0] * 9):
        g = spark.createDataFrame([(0, *xyz, bad)], BOX_OF_ITS_OWN)
        for run in (lambda: pbc.image_distances(g, [(0, 1)]), lambda: pbc.make_whole(g, [(0, 1)], 2), lambda: spatial.rdf(g, [0], [1]), lambda: pbc.wrap(to_long(g, keep=("box",)))):
            with pytest.raises(Exception, match="InvalidBox|without volume"):
                run().collect()


def test_long_chain_is_made_whole(spark):
    """Steps grow with the atoms, not with the square of a chain."""
    n = 3000
    f = frames(spark, [((3.0 * i) % 10, 0, 0) for i in range(n)])
    bonds = [(i, i + 1) for i in range(n - 1)]
    assert sum(len(a) for a, _ in pbc.spanning_steps(bonds, n)) == n - 1
    assert pbc.make_whole(f, bonds, n, [10.0, 0, 0, 0, 10.0, 0, 0, 0, 10.0]).first()["x"] == pytest.approx([3.0 * i for i in range(n)])


def test_close_pairs_against_all_pairs():
    import numpy as np

    from trajix.functions import points

    rng = np.random.default_rng(2)
    p, group = rng.uniform(-20, 20, (600, 3)), rng.integers(0, 3, 600)
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(2))
    expected = {(i, j) for i, j in zip(*np.nonzero((d < 5) & (group[:, None] == group[None]))) if i != j}
    step, points.STEP_PAIRS = points.STEP_PAIRS, 500
    try:
        found = list(points.close_pairs(p, group, 5.0))
    finally:
        points.STEP_PAIRS = step
    got = [(i, j) for a, b, _ in found for i, j in zip(a, b)]
    assert len(found) > 5 and len(got) == len(set(got)) and set(got) == expected


def test_frame_values_need_no_shuffle(spark):
    f = frames(spark, [(0, 0, 0), (1, 0, 0)], [(0, 0, 0), (2, 0, 0)])
    ref = superposition.reference_of(f, 0)
    for df in (frame_sums.center(f, [1.0, 1.0]), frame_sums.radius_of_gyration(f), frame_sums.inertia(f, [1.0, 1.0]), superposition.rmsd(f, ref), sasa.total_by_frame(f, [1.7, 1.7])):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_frames_of_different_sizes_and_none(spark):
    f = frames(spark, [(0, 0, 0), (2, 0, 0)], [(1, 1, 1)], [(0, 0, 0), (0, 4, 0)])
    assert values(frame_sums.radius_of_gyration(f), "frame") == pytest.approx([1, 0, 2])
    assert frame_sums.radius_of_gyration(f.where("false")).count() == 0
    bare = spark.createDataFrame([(0, [], [], [])], FRAME)
    assert tuple(frame_sums.center(bare).first())[1:] == (0, 0, 0) and sasa.total_by_frame(bare, []).first()["area"] == 0
    with pytest.raises(Exception, match="IndexError"):
        frame_sums.center(f, None, [5]).collect()


def test_every_residue_and_projections(spark):
    import numpy as np

    t = topology(spark, [("N", 7, 0), ("CA", 6, 0), ("C", 6, 0), ("O", 8, 0), ("N", 7, 1)], [("GLY", 0), ("ALA", 0)])
    f = frames(spark, [(0, 0, 0), (1, 0, 0), (2, 0, 0), (2, 1, 0), (3, 0, 0)])
    codes_of = dssp.every_residue(dssp.dssp(f, t.table()), t.table()).orderBy("residue_index").collect()
    assert [r["code"] for r in codes_of] == [" ", " "] and dssp.dssp(f, t.table()).count() == 1
    r = np.random.default_rng(3).normal(size=(12, 3, 3)) * [3, 1, 0.2]
    f = frames(spark, *r.tolist())
    head, loads = over_time.pca(f, None, 2)
    found = over_time.projections(f, loads).groupBy("component").agg(F.var_samp("value").alias("v")).orderBy("component").collect()
    assert [x["v"] for x in found] == pytest.approx(values(head, "component", "eigenvalue"))
    whole = over_time.pca(f)[0]
    assert values(whole, "component", "eigenvalue")[:2] == pytest.approx(values(head, "component", "eigenvalue"), rel=1e-9)
    assert values(whole, "component", "variance_ratio")[:2] == pytest.approx(values(head, "component", "variance_ratio"), rel=1e-9)


def codes(n, bonds=(), pairs=(), segment=None, kappa=None, phi=None, psi=None, prefer_pi=True):
    import numpy as np

    two = lambda rows: tuple(np.array(rows, int).reshape(-1, 2).T)
    angle = lambda v: np.array([v or [None] * n], float)
    return "".join(dssp.assign_frames(np.zeros(n, int), np.array([segment or [0] * n]), two(bonds), two(pairs), angle(kappa), angle(phi), angle(psi), prefer_pi)[0][0])


def test_helices():
    for stride, mark in ((4, "H"), (3, "G"), (5, "I")):
        bonds = [(i + stride, i) for i in range(1, 4)]
        got = codes(14, bonds)
        assert got[2 : 2 + stride + 1] == mark * (stride + 1), got
        assert got[1] == " " or got[1] == "T"
    broken = [0] * 4 + [1] * 10
    assert "H" not in codes(14, [(i + 4, i) for i in range(1, 4)], segment=broken)
    both = [(i + 4, i) for i in range(1, 4)] + [(i + 5, i) for i in range(1, 4)]
    assert "I" in codes(14, both) and "I" not in codes(14, both, prefer_pi=False)


def test_strands_bridges_and_bulges():
    anti = [(2, 11), (11, 2), (4, 9), (9, 4), (6, 7)]
    got = codes(14, anti, [(2, 11), (4, 9), (3, 10)])
    assert got[2] == got[11] == "B" or got[2] == "E"
    ladder = [(3, 10), (10, 3), (5, 8), (8, 5)]
    assert codes(14, ladder, [(3, 10), (4, 9), (5, 8)])[3:6] == "EEE"
    parallel = [(3, 9), (9, 1), (5, 11), (11, 3)]
    assert codes(16, parallel, [(2, 9), (4, 11)])[2] in "BE"
    assert codes(8, [(2, 5), (5, 2)], [(2, 5)])[2] == "B"
    assert codes(8, [(2, 5), (5, 2)], [(2, 5)], segment=[0, 0, 1, 1, 1, 1, 1, 1])[2] == " "


def test_turns_bends_and_polyproline():
    assert codes(6, [(4, 1)])[2:4] == "TT"
    assert codes(6, kappa=[None, None, 80.0, 60.0, None, None]) == "  S   "
    assert codes(8, phi=[-75.0] * 8, psi=[145.0] * 8)[1:7] == "PPPPPP"


def test_dssp_needs_complete_residues(spark):
    t = topology(spark, [("N", 7, 0), ("CA", 6, 0)], [("GLY", 0)])
    with pytest.raises(dssp.NoCompleteResidues):
        dssp.dssp(frames(spark, [(0, 0, 0), (1, 0, 0)]), t.table())
