"""A trajectory and topologies made of the driver's tables, the same for Spark and for SQL.

Each row of ``embeddings`` is a frame of 21 atoms: 20 times three components each, in Å.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajix.model import ATOMS, BONDS, CHAINS, RESIDUES, Topology, listed

N_ATOMS = 21
BOX = [15.0, 0.0, 0.0, 0.0, 15.0, 0.0, 0.0, 0.0, 15.0]
SKEWED = [15.0, 0.0, 0.0, 4.0, 14.0, 0.0, -3.0, 5.0, 13.0]
RESIDUE_NAMES = ["ALA", "GLY", "HOH", "PRO", "LYS"]
NUMBER = {"H": 1, "C": 6, "N": 7, "O": 8, "S": 16}
#: Backbones of five residues in two chains, and a hydrogen on the last nitrogen.
MAIN = [(i, ["N", "CA", "C", "O"][i % 4], [7, 6, 6, 8][i % 4], i // 4) for i in range(20)] + [(20, "H", 1, 4)]
#: Four residues with side chains.
SIDE_NAMES = ["N CA CB CG CD NE CZ".split(), "N CA CB CG1 CD1".split(), "N CA CB CG SD CE".split(), "N CA CB".split()]
SIDE = [(i, n, NUMBER[n[0]], r) for i, (n, r) in enumerate((n, r) for r, names in enumerate(SIDE_NAMES) for n in names)]
BONDED = [(i, i + 1) for i in range(19) if i // 4 == (i + 1) // 4] + [(16, 20)]

# Ideal backbones: lengths in Å, angles in degrees, (phi, psi) of each kind of secondary structure.
N_CA, CA_C, C_N, C_O = 1.458, 1.525, 1.329, 1.231
AT_N, AT_CA, AT_C, AT_O = 121.7, 111.0, 117.2, 120.1
POLYPROLINE, ALPHA, TIGHT, WIDE, EXTENDED, LOOSE = (-75, 145), (-60, -45), (-55, -22), (-65, -62), (-119, 113), (-90, 80)
COILED = [POLYPROLINE] * 7 + [LOOSE] + [ALPHA] * 12 + [LOOSE] * 2 + [TIGHT] * 8 + [LOOSE] * 2 + [WIDE] * 12
STRAND, BESIDE, ALONG, BULGE = 8, 4.6, -0.6, 4


def _next_atom(a: np.ndarray, b: np.ndarray, c: np.ndarray, length: float, angle: float, torsion: float) -> np.ndarray:
    """The atom bonded to c, at an angle to b and a torsion about b-c to a."""
    angle, torsion = np.radians(angle), np.radians(torsion)
    along = (c - b) / np.linalg.norm(c - b)
    up = np.cross(b - a, along)
    up /= np.linalg.norm(up)
    return c + length * (np.sin(angle) * (np.cos(torsion) * np.cross(up, along) + np.sin(torsion) * up) - np.cos(angle) * along)


def _backbone(torsions: list[tuple[float, float]]) -> np.ndarray:
    """(residues, 4, 3): N, CA, C and O of a chain of trans peptides."""
    n, ca = np.zeros(3), np.array([N_CA, 0.0, 0.0])
    c = ca + CA_C * np.array([-np.cos(np.radians(AT_CA)), np.sin(np.radians(AT_CA)), 0.0])
    out = []
    for (_, psi), (phi, _) in zip(torsions, [*torsions[1:], EXTENDED]):
        out.append((n, ca, c, _next_atom(n, ca, c, C_O, AT_O, psi + 180)))
        n, before = _next_atom(n, ca, c, C_N, AT_C, psi), (ca, c)
        ca = _next_atom(*before, n, N_CA, AT_N, 180)
        c = _next_atom(before[1], n, ca, CA_C, AT_CA, phi)
    return np.array(out)


def _folded() -> list[tuple]:
    """(atom_index, name, element, residue, residue name, chain, x, y, z): a chain of helices and a polyproline
    stretch whose last residue lacks C and O, three strands of a sheet, the second parallel to the first and the third not,
    and two strands of another, of which one has a residue more that stands out of the sheet."""
    s = _backbone([EXTENDED] * STRAND)
    axis = s[-1, 1] - s[0, 1]
    axis /= np.linalg.norm(axis)
    side = (s[::2, 3] - s[::2, 2]).mean(0)
    side -= side @ axis * axis
    side /= np.linalg.norm(side)
    s = (s - s.reshape(-1, 3).mean(0)) @ np.stack([side, np.cross(axis, side), axis]).T
    before, after, out_of_sheet = s[BULGE - 1], s[BULGE], np.array([0.0, 1.0, 0.0])
    extra = np.stack([before[2] + 1.3 * out_of_sheet, (before[2] + after[0]) / 2 + 2.5 * out_of_sheet, after[0] + 1.3 * out_of_sheet, after[0] + 2.5 * out_of_sheet])
    bulged = np.concatenate([s[:BULGE], extra[None], s[BULGE:]])
    third = [BESIDE, 0.0, ALONG]
    chains = [_backbone(COILED) + [0.0, 40.0, 0.0], s, s + [BESIDE, 0.0, 0.0], s * [1, -1, -1] + [BESIDE, 0.0, 0.0] + third, bulged + [0.0, -40.0, 0.0], s * [1, -1, -1] + [0.0, -40.0, 0.0] + third]
    out, residue = [], 0
    for chain, points in enumerate(chains):
        for k, own in enumerate(points):
            missing = chain == 0 and k == len(points) - 1
            name = "PRO" if chain == 0 and k in (3, 5) else "ALA"
            out += [(len(out) + i, n, NUMBER[n[0]], residue, name, chain, *xyz) for i, (n, xyz) in enumerate(zip(["N", "CA", "C", "O"], own.round(3).tolist())) if not (missing and i > 1)]
            residue += 1
    return out


FOLDED = _folded()
#: Å times an embedding's components, by frame modulo four.
SHAKEN = [1.0, 2.0, 3.0, 4.0]


def shaken_by(atom: int, axis: int) -> int:
    """The component that moves an atom along an axis."""
    return (7 * atom + 21 * axis) % 64


def folded_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame, x, y, z: the folded chains, each atom moved by components of the frame's embedding."""
    e = F.col("embedding")
    scale = F.element_at(listed(SHAKEN, "array<double>"), (F.col("vec_id") % 4 + 1).cast("int"))
    moved = lambda i: F.transform(listed([{"at": a[6 + i], "e": shaken_by(a[0], i)} for a in FOLDED], "array<struct<at:double,e:int>>"), lambda t: t["at"] + scale * F.get(e, t["e"]).cast("double"))
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("frame"), *[moved(i).alias(c) for i, c in enumerate("xyz")])


def folded_topology(spark: SparkSession) -> Topology:
    residues = sorted({(a[3], a[4], a[3] + 1, a[5]) for a in FOLDED})
    return Topology(
        spark.createDataFrame([(*a[:4], None, None) for a in FOLDED], ATOMS),
        spark.createDataFrame(residues, RESIDUES),
        spark.createDataFrame([(c, "ABCDEF"[c]) for c in sorted({a[5] for a in FOLDED})], CHAINS),
        spark.createDataFrame([], BONDS),
    )


def chain_of(residue: int) -> int:
    return int(residue > 2)


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame, x, y, z."""
    e = F.col("embedding")
    axes = [_axis(e, c).alias(a) for c, a in enumerate("xyz")]
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("frame"), *axes)


def trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same frames as a trajectory for each label: traj, frame, x, y, z."""
    labels = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("frame"), F.concat(F.lit("label "), F.col("label")).alias("traj"))
    return frames(spark, sf_dir).join(labels, "frame").select("traj", "frame", *"xyz")


def boxed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames with a box of their own: the skewed one, longer by 0.01 Å in each direction from frame to frame."""
    box = F.array(*[F.lit(v) + F.col("frame") * (0.01 if i % 4 == 0 else 0.0) for i, v in enumerate(SKEWED)])
    return frames(spark, sf_dir).withColumn("box", box)


def large_frames(spark: SparkSession, sf_dir: str, atoms: int = 5_000) -> DataFrame:
    """frame, x, y, z of frames of ``atoms`` rows of ``lineitem`` each, in a cube of 64 Å: as many frames as the table fills."""
    key, line = F.col("l_orderkey"), F.col("l_linenumber")
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(key, line, *[((F.pmod(F.xxhash64(F.lit(c), key, line), F.lit(64_000))) / 1000.0).alias(c) for c in "xyz"])
    # a frame is a share of the keys' hashes, with a few more rows than it takes
    parts = max(1, int(rows.count() / (1.05 * atoms)))
    dealt = rows.groupBy(F.pmod(F.xxhash64("l_orderkey", "l_linenumber"), F.lit(parts)).alias("frame")).agg(F.slice(F.sort_array(F.collect_list(F.struct("l_orderkey", "l_linenumber", *"xyz"))), 1, atoms).alias("r"))
    return dealt.where(F.size("r") == atoms).select("frame", *[F.col(f"r.{c}").alias(c) for c in "xyz"])


def _axis(e, c: int):
    return F.array(*[20.0 * F.get(e, F.lit(3 * k + c)).cast("double") for k in range(N_ATOMS)])


def topology(spark: SparkSession, side: bool = False) -> Topology:
    own = SIDE if side else MAIN
    residues = [(r, RESIDUE_NAMES[r], r + 1, 0 if side else chain_of(r)) for r in range(4 if side else 5)]
    return Topology(
        spark.createDataFrame([(*a, None, None) for a in own], ATOMS),
        spark.createDataFrame(residues, RESIDUES),
        spark.createDataFrame([(c, "AB"[c]) for c in sorted({r[3] for r in residues})], CHAINS),
        spark.createDataFrame([] if side else BONDED, BONDS),
    )
