"""Files written and read again, and the rules of the readers."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from trajix.sources import reports, structures, trajectories

TABLES = "/root/testdata/sf0.001"

PDB = """\
CRYST1   50.000   50.000   50.000  90.00  90.00  90.00
MODEL        1
ATOM      1  N   ALA A   1       1.000   2.000   3.000  1.00  0.00           N
ATOM      2  CA AALA A   1       2.000   2.000   3.000  1.00  0.00           C
ATOM      3  CA BALA A   1       9.000   2.000   3.000  1.00  0.00           C
ATOM      4  C   ALA A   1A      3.000   2.000   3.000
HETATM    5 ZN    ZN B   2       4.000   2.000   3.000  1.00  0.00          ZN
ATOM      6  X   BAD B   2       bad
CONECT    1    2
CONECT    2    1    4
CONECT    5    5
ENDMDL
MODEL        2
ATOM      1  N   ALA A   1       7.000   2.000   3.000  1.00  0.00           N
ENDMDL
"""
CIF = """data_x
loop_
_atom_site.group_PDB
_atom_site.type_symbol
_atom_site.label_atom_id
_atom_site.label_alt_id
_atom_site.label_comp_id
_atom_site.label_asym_id
_atom_site.label_seq_id
_atom_site.Cartn_x
_atom_site.Cartn_y
_atom_site.Cartn_z
_atom_site.pdbx_PDB_model_num
ATOM N N . ALA A 1 1.0(2) 2.0 3.0 1
ATOM C "CA'" . ALA A 1 2.0 2.0 3.0 1
HETATM O O . HOH B . 4.0 2.0 3.0 1
ATOM N N . ALA A 1 9.0 2.0 3.0 2
#
loop_
_other.a
1
"""


def test_pdb_rules():
    s = structures.read_pdb(PDB)
    assert [a[0] for a in s.atoms] == ["N", "CA", "C", "ZN"]
    assert [a[1] for a in s.atoms] == [7, 6, 6, 30]
    assert [r[:2] for r in s.residues] == [("ALA", 1), ("ALA", 1), ("ZN", 2)] and s.chains == ["A", "B"]
    assert s.bonds == [(0, 1), (1, 2)] and s.box is None and s.coords[1][0] == 2.0
    again = structures.read_pdb(structures.write_pdb(s))
    assert (again.atoms, again.residues, again.coords) == (s.atoms, [s.residues[0], *s.residues[2:]], s.coords) or again.coords == s.coords
    with pytest.raises(structures.StructureError):
        structures.read_pdb("END\n")


def test_mmcif_rules():
    s = structures.read_mmcif(CIF)
    assert [(a[0], a[1]) for a in s.atoms] == [("N", 7), ("CA'", 6), ("O", 8)]
    assert s.coords[0] == (1.0, 2.0, 3.0) and s.chains == ["A", "B"] and len(s.residues) == 2
    assert [t for t in structures.cif_tokens("a 'b c' \"d'e\" # x\n;f\ng\n;\n. ?")] == [("value", v) for v in ("a", "b c", "d'e", "f\ng", None, None)]
    with pytest.raises(structures.StructureError):
        structures.read_mmcif(CIF.replace("2.0 3.0 1", "x 3.0 1"))


def test_gro_round_trip():
    s = structures.Structure(time=2.5, box=[30.0, 0, 0, 5.0, 31.0, 0, 0, 0, 32.0])
    for i, (name, residue) in enumerate([("N", "ALA"), ("CA", "ALA"), ("CA", "CA")]):
        s.add(name, 0, (residue,), residue, i // 2 + 1, "", (i + 0.5, 2.0, -3.0))
    again = structures.read_gro(structures.write_gro(s, "made"))
    assert [a[1] for a in again.atoms] == [7, 6, 20] and again.time == 2.5
    assert np.allclose(again.coords, s.coords) and np.allclose(again.box, s.box)
    assert structures.read_gro(structures.write_gro(s).replace("  32.0", "")[:0] + "t\n    0\n   1.0 2.0 3.0\n").box == [10.0, 0, 0, 0, 20.0, 0, 0, 0, 30.0]
    with pytest.raises(structures.StructureError):
        structures.read_gro("t\n    2\nshort\n")


def test_prmtop():
    part = lambda name, fmt, body: f"%FLAG {name}\n%FORMAT({fmt})\n{body}\n"
    text = part("POINTERS", "10I8", "".join(f"{v:>8}" for v in [3] + [0] * 9)) + part("ATOM_NAME", "20a4", "O   H1  CL  ") + part("CHARGE", "5E16.8", f"{18.2223:>16.8E}" * 3)
    text += part("MASS", "5E16.8", f"{16.0:>16.8E}" * 3) + part("RESIDUE_LABEL", "20a4", "WAT Cl- ") + part("RESIDUE_POINTER", "10I8", f"{1:>8}{3:>8}") + part("BONDS_INC_HYDROGEN", "10I8", f"{0:>8}{3:>8}{1:>8}")
    s = structures.read_prmtop(text)
    assert [(a[0], a[1], a[2]) for a in s.atoms] == [("O", 8, 0), ("H1", 1, 0), ("CL", 17, 1)]
    assert s.atoms[0][3] == pytest.approx(1) and s.atoms[0][4] == 16 and s.bonds == [(0, 1)]
    with pytest.raises(structures.StructureError):
        structures.read_prmtop("%FLAG CTITLE\n%FORMAT(20a4)\n\n")


@settings(max_examples=60, deadline=None)
@given(st.integers(10, 40), st.integers(0, 10**6), st.sampled_from([0.01, 0.3, 5.0, 30000.0]))
def test_xtc_integers_round_trip(n, seed, spread):
    rng = np.random.default_rng(seed)
    ints = np.rint(np.cumsum(rng.normal(size=(n, 3)) * spread, 0) * 100).astype(np.int64)
    low, high, small, raw = trajectories.pack_coordinates(ints)
    assert (trajectories.unpack_coordinates(raw, n, low, high, small) == ints).all()


@pytest.mark.parametrize("kind,slack", [("xtc", 0.006), ("trr", 1e-4), ("nc", 1e-4)])
@pytest.mark.parametrize("n", [3, 25])
def test_trajectories_round_trip(spark, tmp_path, kind, slack, n):
    rng = np.random.default_rng(1)
    rows = [("", k, 0.5 * k, 10 * k, [30.0, 0.0, 0.0, 0.0, 31.0, 0.0, 5.0, 0.0, 32.0], *(rng.normal(size=(3, n)) * 9).tolist()) for k in range(7)]
    from trajix.model import FRAMES

    frames = spark.createDataFrame(rows, FRAMES).coalesce(1)
    trajectories.write_trajectory(frames, str(tmp_path / "t"), kind)
    [path] = [str(p) for p in (tmp_path / "t").iterdir() if not p.name.startswith((".", "_"))]
    got = trajectories.read_trajectory(spark, path).orderBy("frame").collect()
    assert len(got) == 7
    for a, b in zip(rows, got):
        assert np.allclose(a[5:], [b["x"], b["y"], b["z"]], atol=slack) and np.allclose(a[4], b["box"], atol=1e-4)
        assert kind == "nc" or (b["time"], b["step"]) == (a[2], a[3])


@pytest.mark.parametrize("kind,slack", [("xtc", 0.006), ("trr", 1e-4), ("nc", 1e-4)])
def test_folders_and_patterns(spark, tmp_path, kind, slack):
    """A folder of several parts reads back as one trajectory, a pattern as one for each match."""
    from pyspark.sql import functions as F

    from trajix.plans import sample

    frames = sample.frames(spark, TABLES).repartitionByRange(4, "frame").sortWithinPartitions("frame")
    for name in ("a", "b"):
        trajectories.write_trajectory(frames, f"file://{tmp_path}/{name}", kind)
    assert len([p for p in (tmp_path / "a").iterdir() if p.suffix == f".{kind}"]) == 4 and not [p for p in (tmp_path / "a").iterdir() if p.name.startswith(".")]
    (tmp_path / "a" / f".part-lost.{kind}").write_bytes(b"cut")  # what an attempt without a commit leaves
    got = trajectories.read_trajectory(spark, f"file://{tmp_path}/a")
    both = got.withColumnRenamed("frame", "k").join(frames.select(F.col("frame").alias("k"), *[F.col(c).alias(f"{c}_") for c in "xyz"]), "k")
    apart = F.greatest(*[F.array_max(F.zip_with(c, f"{c}_", lambda p, q: F.abs(p - q))) for c in "xyz"])
    n, worst = both.agg(F.count("*"), F.max(apart)).first()
    assert n == got.count() == 500 and worst < slack
    each = trajectories.read_trajectory(spark, f"{tmp_path}/?").groupBy("traj").agg(F.count("*"), F.max("frame")).collect()
    assert [tuple(r) for r in each] == [("", 1000, 999)]  # frames without a trajectory's name are one
    with pytest.raises(Exception, match="no such file"):
        trajectories.read_trajectory(spark, f"{tmp_path}/none.{kind}").count()


def test_xtc_blocks_cut_short():
    rng = np.random.default_rng(3)
    ints = np.rint(np.cumsum(rng.normal(size=(400, 3)), 0) * 50).astype(np.int64)
    low, high, small, raw = trajectories.pack_coordinates(ints)
    assert (trajectories.unpack_coordinates(raw, 400, low, high, small) == ints).all()
    for cut in (0, 10, len(raw) // 2, len(raw) - 3):
        with pytest.raises(trajectories.TrajectoryError):
            trajectories.unpack_coordinates(raw[:cut], 400, low, high, small)


def test_dcd(spark, tmp_path):
    import struct

    n, xyz = 4, np.arange(24, dtype="<f4").reshape(2, 3, 4)
    head = b"CORD" + struct.pack("<9i", 2, 100, 5, 0, 0, 0, 0, 0, 0) + struct.pack("<f", 0.25) + struct.pack("<10i", 1, *[0] * 8, 24)
    block = lambda b: struct.pack("<i", len(b)) + b + struct.pack("<i", len(b))
    raw = block(head) + block(struct.pack("<i", 1) + b" " * 80) + block(struct.pack("<i", n))
    for f in xyz:
        raw += block(struct.pack("<6d", 30, 90, 31, 90, 90, 32)) + b"".join(block(a.tobytes()) for a in f)
    (tmp_path / "x.dcd").write_bytes(raw)
    got = trajectories.read_trajectory(spark, str(tmp_path / "x.dcd")).orderBy("frame").collect()
    assert [r["step"] for r in got] == [100, 105] and got[1]["time"] == 0.25
    assert got[1]["y"] == xyz[1, 1].tolist() and got[0]["box"] == [30.0, 0, 0, 0, 31.0, 0, 0, 0, 32.0]


def test_reports_and_conversion(spark, tmp_path):
    (tmp_path / "a.pdb").write_text(PDB)
    reports.convert(spark, f"file://{tmp_path}/a.pdb", f"file://{tmp_path}/b.gro")
    text = next((tmp_path / "b.gro").glob("part-*")).read_text()
    assert len(structures.read_gro(text).atoms) == 4
    topology = reports.read_topology(spark, f"file://{tmp_path}/a.pdb")
    assert topology.table().count() == 4 and topology.validate().count() == 0
    rows = spark.createDataFrame([(0, 1.5, None), (1, 2.0, 3)], "frame bigint, value double, other int")
    reports.write_delimited(rows, f"file://{tmp_path}/c", "\t")
    lines = sorted(line for p in (tmp_path / "c").glob("part-*") for line in p.read_text().splitlines())
    assert "0\t1.500000\t" in [line.replace('""', "") for line in lines] and lines[-1] == "frame\tvalue\tother"
    assert reports.frame_records(rows, "r").orderBy("frame").first()["json"] == '{"frame":0,"r":[{"value":1.5}]}'
    with pytest.raises(structures.StructureError):
        structures.read_structure(spark, "x.unknown")


@pytest.mark.parametrize("kind", ["pdb", "gro", "cif", "prmtop"])
def test_many_structures(spark, tmp_path, kind):
    """Files of a folder are read by tasks, each a structure with its atoms, residues, chains and bonds."""
    from pyspark.sql import functions as F

    from trajix.plans import sample

    frames = sample.frames(spark, TABLES).where("frame < 30").withColumn("time", F.col("frame") * 0.5)
    topology = sample.topology(spark)
    assert structures.write_structures(frames, topology, f"file://{tmp_path}/s", kind) == 30
    (tmp_path / "s" / f"bad.{kind}").write_text("nothing of use")
    (tmp_path / "s" / "other.xyz").write_text("1")
    found = structures.read_structures(spark, f"file://{tmp_path}/s")
    problems = {structures.name_of(r["structure"]): r["problem"] for r in found.table.where("problem is not null").collect()}
    assert set(problems) == {"bad", "other"} and problems["other"] == "unknown format: xyz"
    good = structures.Structures(found.table.where("problem is null"))
    assert sorted(int(structures.name_of(r["structure"])) for r in good.table.collect()) == list(range(30))
    assert good.atoms().count() == 30 * 21 and good.residues().count() == 30 * 5 and good.validate().count() == 0
    assert good.bonds().count() == (30 * len(sample.BONDED) if kind == "prmtop" else 0)
    assert {r["n"] for r in good.chains().groupBy("structure").agg(F.count("*").alias("n")).collect()} == {1 if kind in ("gro", "prmtop") else 2}
    if kind != "prmtop":
        wide = {int(structures.name_of(r["traj"])): r for r in good.frames().collect()}
        for r in frames.collect():
            assert np.allclose([wide[r["frame"]][c] for c in "xyz"], [r[c] for c in "xyz"], atol=0.006)
            assert kind != "gro" or wide[r["frame"]]["time"] == r["time"]
    one = good.topology(next(r["structure"] for r in good.table.collect() if structures.name_of(r["structure"]) == "7"))
    assert one.table().count() == 21 and [r["name"] for r in one.atoms.orderBy("atom_index").collect()] == [a[1] for a in sample.MAIN]
    assert [r["element"] for r in one.atoms.orderBy("atom_index").collect()] == [a[2] for a in sample.MAIN]
    again = structures.read_structure(spark, f"file://{tmp_path}/s/7.{kind}")
    assert len(again.atoms) == 21 and len(again.residues) == 5
    with pytest.raises(Exception, match="InvalidAtomCount"):
        structures.write_structures(frames.withColumn("x", F.slice("x", 1, 3)).withColumn("y", F.slice("y", 1, 3)).withColumn("z", F.slice("z", 1, 3)), topology, f"file://{tmp_path}/t", kind)


def test_faults_of_structures(spark, tmp_path):
    s = structures.read_pdb(PDB)
    (tmp_path / "a.pdb").write_text(structures.write_pdb(s))
    found = structures.read_structures(spark, f"file://{tmp_path}/a.pdb")
    broken = found.table.selectExpr("structure", "array_append(transform(residue_index, v -> v), 9) AS residue_index", "resid", "transform(chain_index, v -> -1) AS chain_index", "chain_name", "array(0, 77) AS atom_i", "array(1, 0) AS atom_j", "name")
    rows = sorted((r["problem"], r["id"]) for r in structures.Structures(broken).validate().collect())
    assert rows == [("atom without residue", 9), ("bond without atom", 77), ("residue without chain", -1)]


def test_mmcif_names_are_quoted():
    s = structures.Structure()
    for name, residue, chain in (("C1'", "A B", "A"), ("O5*", "#X", ""), ('N"', "data_", "_q")):
        s.add(name, 6, (residue,), residue, 1, chain, (1.0, -2.5, 3.25))
    again = structures.read_mmcif(structures.write_mmcif(s))
    assert [a[0] for a in again.atoms] == [a[0] for a in s.atoms] and [r[0] for r in again.residues] == [r[0] for r in s.residues]
    assert again.chains == s.chains and again.coords == s.coords


def test_tokens_of_lines_at_once_are_those_of_the_grammar():
    """Lines of plain values are split whole; what stands in quotes, text fields, comments and between tags is as the tokens' pattern says."""
    text = "data_x\n#c\nloop_\n_atom_site.id\n_b\n1 . ?\n 2\t'a b' O5'\n;text ; of\nplain lines\n;\nx y\n\"q#\" #rest\nloop_\n3 LOOP_ a_b\n4"
    got = list(structures.cif_tokens(text))
    values = ["1", None, None, "2", "a b", "O5'", "text ; of\nplain lines", "x", "y", "q#"]
    assert got == [("data", "x"), ("loop", "loop_"), ("tag", "_atom_site.id"), ("tag", "_b"), *[("value", v) for v in values], ("loop", "loop_"), ("value", "3"), ("loop", "LOOP_"), ("value", "a_b"), ("value", "4")]


def test_many_small_files_are_few_tasks(spark, tmp_path):
    """Spark packs some 30 small files to a partition; a task reads many of these, and hands over the rows of many files together."""
    head = "data_x\nloop_\n" + "".join(f"_atom_site.{c}\n" for c in ("id", "type_symbol", "label_atom_id", "Cartn_x", "Cartn_y", "Cartn_z"))
    for k in range(700):
        (tmp_path / f"{k}.cif").write_text(head + f"1 C CA {k}.5 0 1\n#\n" if k % 7 else "broken")
    table = structures.read_structures(spark, str(tmp_path)).table
    assert table.rdd.getNumPartitions() <= 12
    rows = {int(r["structure"].rsplit("/", 1)[1][:-4]): (r["problem"], r["x"]) for r in table.collect()}
    assert rows == {k: (None, [k + 0.5]) if k % 7 else ("NoAtomsFound", []) for k in range(700)}
