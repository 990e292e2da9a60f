"""Distances, angles and torsions, worked out inside each wide frame without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajix.functions import vectors as V
from trajix.model import at, keys, listed

# Atom names of the side-chain torsions, in order of preference.
CHI = {
    1: ["N CA CB CG", "N CA CB CG1", "N CA CB SG", "N CA CB OG", "N CA CB OG1"],
    2: ["CA CB CG CD", "CA CB CG CD1", "CA CB CG1 CD1", "CA CB CG OD1", "CA CB CG ND1", "CA CB CG SD"],
    3: ["CB CG CD NE", "CB CG CD CE", "CB CG CD OE1", "CB CG SD CE"],
    4: ["CG CD NE CZ", "CG CD CE NZ"],
}


def _each(frames: DataFrame, rows: list[dict], schema: str) -> DataFrame:
    """A row per frame and listed row; the list travels inside the plan."""
    return frames.select(*keys(frames), "x", "y", "z", F.explode(listed(rows, f"array<struct<{schema}>>")).alias("t"))


def _points(n: int) -> list[V.Vector]:
    return [tuple(at(c, F.col(f"t.i{k}")) for c in "xyz") for k in range(n)]


def _tuples(frames: DataFrame, tuples: list[tuple[int, ...]], name: str, value) -> DataFrame:
    arity = len(tuples[0]) if tuples else {"pair": 2}.get(name, 3)
    rows = [{"n": n} | {f"i{k}": i for k, i in enumerate(t)} for n, t in enumerate(tuples)]
    each = _each(frames, rows, "n:int," + ",".join(f"i{k}:int" for k in range(arity)))
    return each.select(*keys(frames), F.col("t.n").alias(name), value(*_points(arity)).alias("value"))


def distances(frames: DataFrame, pairs: list[tuple[int, int]]) -> DataFrame:
    """frame, pair, value."""
    return _tuples(frames, pairs, "pair", V.distance)


def angles(frames: DataFrame, triplets: list[tuple[int, int, int]]) -> DataFrame:
    """frame, tuple, value at the middle atom."""
    return _tuples(frames, triplets, "tuple", V.angle)


def dihedrals(frames: DataFrame, quartets: list[tuple[int, int, int, int]]) -> DataFrame:
    """frame, tuple, value."""
    return _tuples(frames, quartets, "tuple", V.dihedral)


def _residue_atoms(table: DataFrame, names: list[str]) -> DataFrame:
    """A row per residue with the first atom of each name, or null."""
    picked = [F.min(F.when(F.col("name") == n, F.col("atom_index"))).alias(n) for n in names]
    return table.groupBy("residue_index", "chain_index").agg(*picked)


def torsion_atoms(table: DataFrame, kind: str | int) -> DataFrame:
    """residue_index and the four atoms i0..i3 of phi, psi, omega or a chi level; null where there are none.

    Neighbours count in file order, and only within a chain.
    """
    if kind in CHI:
        names = sorted({n for p in CHI[kind] for n in p.split()})
        own = _residue_atoms(table, names)
        chosen = F.coalesce(*[F.when(_all_there(p.split()), F.struct(*[F.col(n).alias(f"i{k}") for k, n in enumerate(p.split())])) for p in CHI[kind]])
        return own.select("residue_index", chosen.alias("q")).select("residue_index", *[F.col(f"q.i{k}").alias(f"i{k}") for k in range(4)])
    if kind not in ("phi", "psi", "omega"):
        raise ValueError(f"InvalidChiLevel: {kind}")
    order = Window.orderBy("residue_index")  # one row per residue of one topology

    def near(name: str, step: int) -> Column:
        same = F.lag("chain_index", -step).over(order) == F.col("chain_index") if step else F.lit(True)
        return F.when(same, F.lag(name, -step).over(order) if step else F.col(name))

    steps = {"phi": [("C", -1), ("N", 0), ("CA", 0), ("C", 0)], "psi": [("N", 0), ("CA", 0), ("C", 0), ("N", 1)], "omega": [("CA", 0), ("C", 0), ("N", 1), ("CA", 1)]}[kind]
    return _residue_atoms(table, ["N", "CA", "C"]).select("residue_index", *[near(n, s).alias(f"i{k}") for k, (n, s) in enumerate(steps)])


def _all_there(names: list[str]) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & F.col(n).isNotNull()
    return out


def torsions(frames: DataFrame, table: DataFrame, kind: str | int) -> DataFrame:
    """frame, residue_index and value of phi, psi, omega or chi 1 to 4 of every residue; null where it has none."""
    rows = torsion_atoms(table, kind).orderBy("residue_index").collect()  # residues of one topology
    listing = [{"residue_index": r["residue_index"]} | {f"i{k}": r[f"i{k}"] for k in range(4)} for r in rows]
    each = _each(frames, listing, "residue_index:int,i0:int,i1:int,i2:int,i3:int")
    return each.select(*keys(frames), F.col("t.residue_index").alias("residue_index"), V.dihedral(*_points(4)).alias("value"))
