"""Tables of structures and trajectories.

Topology: atoms (atom_index, name, element, residue_index, charge, explicit_mass), residues
(residue_index, name, resid, chain_index), chains (chain_index, name), bonds (atom_i, atom_j).
Frames, wide: a row per frame with frame, x, y, z (arrays by atom_index) and, where known, traj,
time, step and box (nine numbers, the three box vectors one after another). Lengths are in Å, time
in ps, angles in radians. Operators take wide frames: whatever is worked out within a frame needs no
shuffle, and what is summed over its atoms is summed before any row moves.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajix.elements import MASSES, by_number

ATOMS = "atom_index int, name string, element int, residue_index int, charge double, explicit_mass double"
RESIDUES = "residue_index int, name string, resid int, chain_index int"
CHAINS = "chain_index int, name string"
BONDS = "atom_i int, atom_j int"
FRAMES = "traj string, frame bigint, time double, step int, box array<double>, x array<double>, y array<double>, z array<double>"


@dataclass(frozen=True)
class Topology:
    atoms: DataFrame
    residues: DataFrame
    chains: DataFrame
    bonds: DataFrame

    def table(self) -> DataFrame:
        """Atoms with residue_name, resid, chain_index, mass and vdw radius; sizes decide how Spark joins."""
        residues = self.residues.select("residue_index", F.col("name").alias("residue_name"), "resid", "chain_index")
        return self.atoms.join(residues, "residue_index").withColumn("mass", F.coalesce("explicit_mass", by_number(F.col("element"), MASSES)))

    def validate(self) -> DataFrame:
        """A row (problem, id) for each broken reference; none if the topology is sound."""

        def missing(child: DataFrame, key: str, parent: DataFrame, to: str, problem: str) -> DataFrame:
            lost = child.join(parent.select(F.col(to).alias("__to")), F.col(key) == F.col("__to"), "left_anti")
            return lost.select(F.lit(problem).alias("problem"), F.col(key).cast("bigint").alias("id"))

        return (
            missing(self.atoms, "residue_index", self.residues, "residue_index", "atom without residue")
            .union(missing(self.residues, "chain_index", self.chains, "chain_index", "residue without chain"))
            .union(missing(self.bonds, "atom_i", self.atoms, "atom_index", "bond without atom"))
            .union(missing(self.bonds, "atom_j", self.atoms, "atom_index", "bond without atom"))
        )


def listed(rows: list, schema: str) -> Column:
    """A small list as one constant of the plan, such as the atoms of one topology; JSON keeps doubles whole."""
    return F.from_json(F.lit(json.dumps(rows)), schema)


def keys(frames: DataFrame) -> list[str]:
    """The columns that name a frame."""
    return [c for c in ("traj", "frame") if c in frames.columns]


def to_long(frames: DataFrame, atoms: list[int] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """frame, atom_index, x, y, z in doubles, and columns to ``keep``: all atoms, or the given ones."""
    extra = [*keys(frames), *keep]
    if atoms is None:
        zipped = F.posexplode(F.arrays_zip("x", "y", "z")).alias("atom_index", "r")
        return frames.select(*extra, zipped).select(*extra, "atom_index", *[F.col(f"r.{c}").cast("double").alias(c) for c in "xyz"])
    picked = F.explode(listed(atoms, "array<int>")).alias("atom_index")
    return frames.select(*extra, "x", "y", "z", picked).select(*extra, "atom_index", *[F.get(F.col(c), F.col("atom_index")).cast("double").alias(c) for c in "xyz"])


def to_wide(coords: DataFrame) -> DataFrame:
    """Long rows to a row per frame of each trajectory; atom_index orders the arrays."""
    k = keys(coords)
    rows = coords.groupBy(*k).agg(F.sort_array(F.collect_list(F.struct("atom_index", "x", "y", "z"))).alias("r"))
    return rows.select(*k, *[F.col(f"r.{c}").alias(c) for c in "xyz"])


def check_atom_count(frames: DataFrame, n: int) -> DataFrame:
    """The frames; a frame with another number of atoms fails the job that reads it."""
    return frames.where(F.when(F.size("x") == n, True).otherwise(F.raise_error(F.lit(f"InvalidAtomCount: not {n} atoms")).cast("boolean")))


def at(axis: str, index: Column) -> Column:
    """Coordinate of an atom in a wide frame."""
    return F.get(F.col(axis), index).cast("double")
