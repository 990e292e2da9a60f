"""Tables that combine or sum up other results."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajix.elements import RADII, SYMBOLS
from trajix.functions.points import per_frame
from trajix.model import Topology, keys
from trajix.operators import frame_sums, over_time, sasa, spatial, superposition
from trajix.sources.structures import Structures


def trajectory_info(frames: DataFrame) -> DataFrame:
    """n_frames, first_time, last_time, in one pass."""
    return frames.agg(F.count("*").alias("n_frames"), F.min_by("time", "frame").alias("first_time"), F.max_by("time", "frame").alias("last_time"))


def chain_summary(topology: Topology) -> DataFrame:
    """chain_index, n_residues, n_atoms, first_residue, last_residue."""
    table = topology.table()
    return table.groupBy("chain_index").agg(
        F.count_distinct("residue_index").alias("n_residues"), F.count("*").alias("n_atoms"), F.min("residue_index").alias("first_residue"), F.max("residue_index").alias("last_residue")
    )


def composition(topology: Topology) -> DataFrame:
    """element, n_atoms."""
    return topology.atoms.groupBy("element").agg(F.count("*").alias("n_atoms"))


def chain_summaries(structures: Structures) -> DataFrame:
    """structure, and the columns of ``chain_summary``, of many structures."""
    return structures.named_atoms().groupBy("structure", "chain_index").agg(
        F.count_distinct("residue_index").alias("n_residues"), F.count("*").alias("n_atoms"), F.min("residue_index").alias("first_residue"), F.max("residue_index").alias("last_residue")
    )


def compositions(structures: Structures) -> DataFrame:
    """structure, element, n_atoms."""
    return structures.atoms().groupBy("structure", "element").agg(F.count("*").alias("n_atoms"))


def summary(topology: Topology, frames: DataFrame) -> DataFrame:
    """section, name, value, place: counts, times, the first frame's box, chains and elements, in the order of place."""
    counts = [(n, t.count()) for n, t in (("atoms", topology.atoms), ("residues", topology.residues), ("chains", topology.chains), ("bonds", topology.bonds))]
    info = trajectory_info(frames).first()
    first = frames.orderBy("frame").first()
    box = first["box"] if first is not None and "box" in frames.columns else None
    rows = [("counts", n, str(v)) for n, v in [*counts, ("frames", info["n_frames"])]]
    rows += [("time", n, str(info[n])) for n in ("first_time", "last_time") if info[n] is not None]
    if box:
        square = all(abs(v) < 1e-3 for i, v in enumerate(box) if i % 4)
        rows += [("box", "kind", "orthorhombic" if square else "triclinic"), *[("box", c, " ".join(f"{v:.3f}" for v in box[3 * k : 3 * k + 3])) for k, c in enumerate("abc")]]
    for r in chain_summary(topology).orderBy("chain_index").collect():
        rows.append(("chain", str(r["chain_index"]), f"residues {r['first_residue']} to {r['last_residue']} ({r['n_residues']}), {r['n_atoms']} atoms"))
    for r in composition(topology).orderBy(F.desc("n_atoms"), "element").collect():
        rows.append(("element", SYMBOLS[r["element"]], str(r["n_atoms"])))
    return frames.sparkSession.createDataFrame([(*r, k) for k, r in enumerate(rows)], "section string, name string, value string, place int")


def contact_frequency(frames: DataFrame, found: DataFrame) -> DataFrame:
    """residue_i, residue_j and the share of all frames in which they touch."""
    total = frames.agg(F.count("*").alias("n_frames"))
    n = total.first()["n_frames"]
    return found.groupBy("residue_i", "residue_j").agg((F.count("*") / max(1, n)).alias("frequency"))


def ramachandran(phi: DataFrame, psi: DataFrame, bins: int = 120) -> DataFrame:
    """phi_bin, psi_bin, n over all residues and frames that have both angles; bins of equal width from -pi."""
    k = keys(phi)
    both = phi.where("value is not null").withColumnRenamed("value", "phi").join(psi.where("value is not null").withColumnRenamed("value", "psi"), [*k, "residue_index"])

    def slot(c: str) -> Column:
        return F.least(F.lit(bins - 1), F.floor((F.degrees(c) + 180) / (360 / bins)).cast("int"))

    return both.groupBy(slot("phi").alias("phi_bin"), slot("psi").alias("psi_bin")).agg(F.count("*").alias("n"))


def metric_summary(values: DataFrame, column: str = "value") -> DataFrame:
    """n, mean, std (population), min and max of a column."""
    v = F.col(column)
    return values.agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))


def every_nth(rows: DataFrame, stride: int) -> DataFrame:
    """Rows of each frame whose number the stride divides."""
    return rows.where(F.pmod(F.col("frame"), F.lit(stride)) == 0)


def residue_areas(areas: DataFrame, table: DataFrame) -> DataFrame:
    """frame, residue_index, area."""
    return areas.join(table.select("atom_index", "residue_index"), "atom_index").groupBy(*keys(areas), "residue_index").agg(F.sum("area").alias("area"))


def analyze_all(frames: DataFrame, topology: Topology, reference_frame: int = 0, atoms: list[int] | None = None, contact_cutoff: float = 4.5, with_sasa: bool = True) -> DataFrame:
    """frame, rmsd, rg, cx, cy, cz, n_hbonds, n_contacts (closest heavy atoms) and, if asked, sasa.

    All of it comes from one pass over each frame, in the task that reads it.
    """
    table = topology.table()
    rows = sorted(table.select("atom_index", "mass", "element").collect())
    masses, radii = [r["mass"] for r in rows], [RADII[r["element"]] for r in rows]
    reference = superposition.reference_of(frames, reference_frame)

    bonds = spatial.HydrogenBonds(topology)
    near, residues = spatial.contact_atoms(table, "closest_heavy")

    def alone(points: np.ndarray) -> dict:
        center = frame_sums.about_center(points, masses, atoms)[1]
        out = {"rmsd": superposition.fitted(points, reference, atoms)[1], "rg": frame_sums.gyration(points, masses, atoms)}
        out |= {f"c{c}": np.ascontiguousarray(center[:, i]) for i, c in enumerate("xyz")}
        out |= {"n_hbonds": bonds.counts(points), "n_contacts": np.bincount(spatial.contacts_of(points, near, residues, contact_cutoff)[0], minlength=len(points))}
        return out | ({"sasa": sasa.areas_of(points, radii, atoms, 1.4, 100).sum(1)} if with_sasa else {})

    return per_frame(frames, "rmsd double, rg double, cx double, cy double, cz double, n_hbonds bigint, n_contacts bigint" + ", sasa double" * with_sasa, alone)


def rmsf_of_all(frames: DataFrame, atoms: list[int] | None = None) -> DataFrame:
    """The per-atom part of the combined analysis."""
    return over_time.rmsf(frames, atoms)
