"""Analyses of files from the command line: ``python -m trajix rmsd traj.xtc --top top.pdb --out results``."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from trajix.elements import RADII
from trajix.model import Topology, check_atom_count
from trajix.operators import derived, dssp, frame_sums, geometry, over_time, sasa, selection, spatial, superposition
from trajix.sources import reports, structures, trajectories

COMMANDS = "rmsd rmsf distances angles dihedrals rg center inertia hbonds contacts rdf sasa all dssp phi psi omega chi msd pca summary convert".split()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="trajix", description=__doc__)
    p.add_argument("command", choices=COMMANDS)
    p.add_argument("path", help="trajectory or structure file")
    p.add_argument("--top", help="structure file with the topology; a structure is its own")
    p.add_argument("--out", help="folder for the result; without it, rows are shown; for convert, the target")
    p.add_argument("--format", choices=["json", "csv", "tsv"], default="json")
    p.add_argument("--select", help="backbone, protein, water, name X, index SPEC or an atom name")
    p.add_argument("--ref", type=int, default=0, help="reference frame")
    p.add_argument("--pairs")
    p.add_argument("--triplets")
    p.add_argument("--quartets")
    p.add_argument("--sel1")
    p.add_argument("--sel2")
    p.add_argument("--rmax", type=float, default=10.0)
    p.add_argument("--bins", type=int, default=100)
    p.add_argument("--distance", type=float, default=2.5, help="hydrogen bonds: largest H-A distance")
    p.add_argument("--angle", type=float, default=120.0, help="hydrogen bonds: smallest D-H-A angle")
    p.add_argument("--scheme", choices=["closest", "ca", "closest_heavy"], default="closest_heavy")
    p.add_argument("--cutoff", type=float, default=5.0, help="contacts: distance")
    p.add_argument("--level", type=int, default=1, help="chi: 1 to 4")
    p.add_argument("--components", type=int, help="pca: how many")
    return p


def load(spark: SparkSession, path: str, top: str | None) -> tuple[Topology, DataFrame]:
    """Topology and frames of a trajectory with a structure, or of a structure alone."""
    if structures.extension(path) in structures.READERS:
        s = structures.read_structure(spark, path)
        topology, frames, n = s.topology(spark), s.frame(spark), len(s.atoms)
    else:
        if top is None:
            raise structures.StructureError("a trajectory needs --top")
        s = structures.read_structure(spark, top)
        topology, frames, n = s.topology(spark), trajectories.read_trajectory(spark, path), len(s.atoms)
    return topology, check_atom_count(frames, n).drop("traj")


def analyse(a: argparse.Namespace, topology: Topology, frames: DataFrame) -> DataFrame:
    """The rows of a command."""
    table = topology.table()
    atoms = selection.indices(table, a.select)
    own = sorted((r["atom_index"], r["mass"], r["element"]) for r in table.select("atom_index", "mass", "element").collect())
    masses, radii = [m for _, m, _ in own], [RADII[z] for _, _, z in own]

    def tuples(spec: str | None, arity: int) -> list[tuple[int, ...]]:
        found = selection.parse_tuples(spec or "", arity)
        if not found:
            raise selection.InvalidSpec("no tuples given")
        selection.check_indices([i for t in found for i in t], len(own))
        return found

    match a.command:
        case "rmsd":
            return superposition.rmsd(frames, superposition.reference_of(frames, a.ref), atoms)
        case "rmsf":
            return over_time.rmsf(frames, atoms)
        case "msd":
            return over_time.msd(frames, atoms)
        case "pca":
            return over_time.pca(frames, atoms, a.components)[0]
        case "distances":
            return geometry.distances(frames, tuples(a.pairs, 2))
        case "angles":
            return geometry.angles(frames, tuples(a.triplets, 3))
        case "dihedrals":
            return geometry.dihedrals(frames, tuples(a.quartets, 4))
        case "rg":
            return frame_sums.radius_of_gyration(frames, masses, atoms)
        case "center":
            return frame_sums.center(frames, masses, atoms)
        case "inertia":
            return frame_sums.principal_moments(frame_sums.inertia(frames, masses, atoms))
        case "hbonds":
            return spatial.hydrogen_bonds(frames, topology, a.distance, a.angle)
        case "contacts":
            return spatial.contacts(frames, table, a.scheme, a.cutoff)
        case "rdf":
            first, second = (selection.indices(table, s) or [i for i, _, _ in own] for s in (a.sel1, a.sel2))
            return spatial.rdf_average(frames, first, second, None, 0.0, a.rmax, a.bins)
        case "sasa":
            return sasa.total_by_frame(frames, radii, atoms)
        case "all":
            return derived.analyze_all(frames, topology, a.ref, atoms)
        case "dssp":
            return dssp.dssp_strings(dssp.dssp(frames, table))
        case "phi" | "psi" | "omega":
            return geometry.torsions(frames, table, a.command)
        case "chi":
            return geometry.torsions(frames, table, a.level)
        case "summary":
            return derived.summary(topology, frames)
    raise ValueError(a.command)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("trajix").getOrCreate()
    if a.command == "convert":
        reports.convert(spark, a.path, a.out, reports.read_topology(spark, a.top) if a.top else None)
        return
    rows = analyse(a, *load(spark, a.path, a.top))
    if a.command in ("hbonds", "contacts") and a.format == "json":
        rows = reports.frame_records(rows, a.command)  # a text per frame with its records
    order = [c for c in ("place", "frame", "lag", "bin", "component", "residue_index", "atom_index", "pair", "tuple", "donor", "residue_i", "hydrogen", "residue_j", "acceptor") if c in rows.columns]
    if a.out is None:  # every row, in order, without a collect
        print("\t".join(c for c in rows.columns if c != "place"))
        for row in rows.orderBy(*order).toLocalIterator():
            print("\t".join("" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v) for c, v in row.asDict().items() if c != "place"))
    elif "json" in rows.columns:
        rows.select("json").write.mode("overwrite").text(a.out)
    elif a.format == "json":
        reports.write_json(rows, a.out)
    else:
        reports.write_delimited(rows, a.out, "," if a.format == "csv" else "\t")


if __name__ == "__main__":
    main()
