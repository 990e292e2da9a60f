"""Pairs by distance, and what rests on them: contacts, hydrogen bonds, radial distribution, native contacts.

All atoms of a frame are in its row, so near pairs are found in the task that reads it, by cells of the
cutoff's size, and only what an analysis makes of them becomes rows. ``near_pairs`` is for points that are
rows already: an equi-join on cells, one side repeated into those within the cutoff.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajix.functions import vectors as V
from trajix.functions.points import lists, pairs_between, per_frame, rows_of_frames
from trajix.model import Topology, keys

Found = Iterator[tuple[np.ndarray, dict]]


def near_pairs(a: DataFrame, b: DataFrame, cutoff: float, cells: bool, inclusive: bool = False, when: Column | None = None) -> DataFrame:
    """Rows of ``a`` with those of ``b`` (its columns with _b behind) of the same frame nearer than ``cutoff``, and d.

    Both have a frame's keys, x, y and z; ``when`` may ask for more of a pair.
    """
    k = keys(a)
    b = b.select(*[F.col(c).alias(f"{c}_b") for c in b.columns])
    on = [F.col(c).eqNullSafe(F.col(f"{c}_b")) for c in k]
    drop = [f"{c}_b" for c in k]
    if cells:
        # cells twice as wide as the reach, so that a point is near two of them at most along each axis; a hair more, for rounding
        reach = cutoff * (1 + 1e-9)
        cell = lambda v: F.floor(v / (2 * reach))
        a = a.withColumns({f"c{c}": cell(F.col(c)) for c in "xyz"})
        for c in "xyz":
            b = b.withColumn(f"c{c}_b", F.explode(F.sequence(cell(F.col(f"{c}_b") - reach), cell(F.col(f"{c}_b") + reach))))
        b = b.hint("merge")  # rows repeated into cells are many more than their table's size tells: not to be broadcast
        on += [F.col(f"c{c}") == F.col(f"c{c}_b") for c in "xyz"]
        drop += [f"c{c}" for c in "xyz"] + [f"c{c}_b" for c in "xyz"]
    square = sum(((F.col(c) - F.col(f"{c}_b")) ** 2 for c in "yz"), (F.col("x") - F.col("x_b")) ** 2)
    near = square <= cutoff * cutoff if inclusive else square < cutoff * cutoff
    condition = near if when is None else near & when
    for c in on:
        condition = condition & c
    return a.join(b, condition).withColumn("d", F.sqrt(square)).drop(*drop)


def _chosen(points: np.ndarray, atoms) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The numbers of the chosen atoms that frames have, their points one after another, and the frame of each."""
    own = np.arange(points.shape[1]) if atoms is None else np.array(atoms, np.int64)
    own = own[(own >= 0) & (own < points.shape[1])]
    return own, points[:, own].reshape(-1, 3), np.repeat(np.arange(len(points)), len(own))


def pairs_of(points: np.ndarray, first, second, cutoff: float, inclusive: bool = False) -> Iterator[tuple[np.ndarray, ...]]:
    """(frame, i, j, d) of an atom of ``first`` and one of ``second`` (None: all) near each other in some frames; i may be j."""
    (own, p, frame), (other, q, q_frame) = _chosen(points, first), _chosen(points, second)
    for a, b, d in pairs_between(p, frame, q, q_frame, cutoff, inclusive):
        yield frame[a], own[a % max(1, len(own))], other[b % max(1, len(other))], d


def neighbours(frames: DataFrame, cutoff: float, atoms: list[int] | None = None, inclusive: bool = False) -> DataFrame:
    """frame, i, j, d of atom pairs i < j nearer than the cutoff, or as near."""

    def found(points: np.ndarray) -> Found:
        for frame, i, j, d in pairs_of(points, atoms, atoms, cutoff, inclusive):
            once = i < j
            yield frame[once], {"i": i[once], "j": j[once], "d": d[once]}

    return rows_of_frames(frames, "i int, j int, d double", found)


def neighbours_by_radius(frames: DataFrame, radii: list[float], probe: float) -> DataFrame:
    """frame, i, j, d of atom pairs i < j nearer than both radii and twice the probe."""
    r = np.array(radii, float)

    def found(points: np.ndarray) -> Found:
        for frame, i, j, d in pairs_of(points, np.arange(len(r)), np.arange(len(r)), 2 * (r.max(initial=0) + probe)):
            once = (i < j) & (d < r[i] + r[j] + 2 * probe)
            yield frame[once], {"i": i[once], "j": j[once], "d": d[once]}

    return rows_of_frames(frames, "i int, j int, d double", found)


def neighbour_lists(frames: DataFrame, first: dict[int, float], second: dict[int, float] | None = None, probe: float = 0.0) -> DataFrame:
    """frame, atoms, offsets, members, distances: the neighbours of each atom of ``first`` in compressed rows.

    ``first`` and ``second`` (the same if not given) are atoms with radii of their own; a neighbour is another
    atom of ``second`` nearer than both radii and twice the probe. The neighbours of atoms[k] are
    members[offsets[k]] up to before offsets[k + 1], nearest first.
    """
    second = first if second is None else second
    own, other = (np.array(sorted(s), np.int64) for s in (first, second))
    r, q = (np.array([s[i] for i in sorted(s)], float) for s in (first, second))
    wide = r.max(initial=0) + q.max(initial=0) + 2 * probe

    def listed_rows(points: np.ndarray) -> dict:
        n = points.shape[1]
        if len(own) and own.max() >= n or len(other) and other.max() >= n:
            raise ValueError("IndexOutOfRange")
        parts = []
        for frame, i, j, d in pairs_of(points, own, other, wide):
            a, b = np.searchsorted(own, i), np.searchsorted(other, j)
            near = (i != j) & (d < r[a] + q[b] + 2 * probe)
            parts.append((frame[near] * len(own) + a[near], j[near], d[near]))
        key, j, d = (np.concatenate([p[c] for p in parts]) if parts else np.zeros(0) for c in range(3))
        order = np.lexsort((j, d, key))
        counts = np.bincount(key.astype(np.int64), minlength=len(points) * len(own)).reshape(len(points), len(own))
        offsets = np.concatenate([np.zeros((len(points), 1), np.int64), np.cumsum(counts, axis=1)], axis=1)
        of_frame = pa.array(np.concatenate([[0], np.cumsum(counts.sum(1))]), pa.int32())
        members, apart = pa.array(j[order], pa.int32()), pa.array(d[order], pa.float64())
        return {
            "atoms": lists(np.tile(own, (len(points), 1)).astype(np.int32)),
            "offsets": lists(offsets.astype(np.int32)),
            "members": pa.ListArray.from_arrays(of_frame, members),
            "distances": pa.ListArray.from_arrays(of_frame, apart),
        }

    return per_frame(frames, "atoms array<int>, offsets array<int>, members array<int>, distances array<double>", listed_rows)


def contacts_of(points: np.ndarray, atoms: np.ndarray, residues: np.ndarray, cutoff: float) -> tuple[np.ndarray, ...]:
    """(frame, residue_i, residue_j, distance) of residue pairs i < j with an atom each nearer than the cutoff; ``residues`` by atom."""
    span = int(residues.max(initial=0)) + 1
    best: list[tuple[np.ndarray, np.ndarray]] = []

    def least(key: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((d, key))
        key, d = key[order], d[order]
        first = np.append(True, key[1:] != key[:-1]) if len(key) else np.zeros(0, bool)
        return key[first], d[first]

    for frame, i, j, d in pairs_of(points, atoms, atoms, cutoff):
        ri, rj = residues[i], residues[j]
        up = ri < rj
        best.append(least((frame[up] * span + ri[up]) * span + rj[up], d[up]))
    key, d = least(*(np.concatenate([b[c] for b in best]) for c in (0, 1))) if best else (np.zeros(0, np.int64), np.zeros(0))
    return key // span // span, key // span % span, key % span, d


def contact_atoms(table: DataFrame, scheme: str) -> tuple[np.ndarray, np.ndarray]:
    """The atoms that a scheme compares, and the residue of every atom. Schemes: closest (any atoms), ca (first CA of each
    residue), closest_heavy (atoms but hydrogen)."""
    if scheme not in ("closest", "ca", "closest_heavy"):
        raise ValueError(scheme)
    rows = sorted(table.select("atom_index", "residue_index", "name", "element").collect())
    residues = np.zeros(max((r["atom_index"] for r in rows), default=-1) + 1, np.int64)
    for r in rows:
        residues[r["atom_index"]] = r["residue_index"]
    if scheme == "ca":
        first: dict[int, int] = {}
        for r in rows:
            if r["name"] == "CA":
                first.setdefault(r["residue_index"], r["atom_index"])
        return np.array(sorted(first.values()), np.int64), residues
    return np.array([r["atom_index"] for r in rows if scheme == "closest" or r["element"] != 1], np.int64), residues


def contacts(frames: DataFrame, table: DataFrame, scheme: str = "closest", cutoff: float = 5.0) -> DataFrame:
    """frame, residue_i, residue_j, distance of residue pairs i < j nearer than the cutoff, by a scheme of ``contact_atoms``."""
    atoms, residues = contact_atoms(table, scheme)

    def found(points: np.ndarray) -> Found:
        frame, i, j, d = contacts_of(points, atoms, residues, cutoff)
        yield frame, {"residue_i": i, "residue_j": j, "distance": d}

    return rows_of_frames(frames, "residue_i int, residue_j int, distance double", found)


def donors_near(points: np.ndarray, elements: np.ndarray, cutoff: float) -> tuple[np.ndarray, ...]:
    """(frame, donor, hydrogen): each hydrogen's nearest N or O nearer than the cutoff; ties to the smaller number."""
    hydrogens, heavy = np.flatnonzero(elements == 1), np.flatnonzero(np.isin(elements, (7, 8)))
    parts = list(pairs_of(points, hydrogens, heavy, cutoff))
    if not parts:
        return (np.zeros(0, np.int64),) * 3
    frame, h, donor, d = (np.concatenate([p[c] for p in parts]) for c in range(4))
    order = np.lexsort((donor, d, h, frame))
    frame, h, donor = frame[order], h[order], donor[order]
    first = np.append(True, (frame[1:] != frame[:-1]) | (h[1:] != h[:-1])) if len(h) else np.zeros(0, bool)
    return frame[first], donor[first], h[first]


def _elements(topology: Topology) -> np.ndarray:
    rows = topology.atoms.select("atom_index", "element").collect()
    out = np.zeros(max((r["atom_index"] for r in rows), default=-1) + 1, np.int64)
    for r in rows:
        out[r["atom_index"]] = r["element"]
    return out


def infer_donor_hydrogens(frames: DataFrame, topology: Topology, cutoff: float = 1.3) -> DataFrame:
    """frame, donor, hydrogen: each hydrogen's nearest N or O nearer than the cutoff; ties to the smaller index."""
    elements = _elements(topology)

    def found(points: np.ndarray) -> Found:
        frame, donor, hydrogen = donors_near(points, elements, cutoff)
        yield frame, {"donor": donor, "hydrogen": hydrogen}

    return rows_of_frames(frames, "donor int, hydrogen int", found)


def donor_hydrogens(topology: Topology) -> DataFrame:
    """donor, hydrogen: bonds between an N or O and a hydrogen."""
    element = topology.atoms.select("atom_index", "element")
    bonds = topology.bonds.select(F.col("atom_i").alias("donor"), F.col("atom_j").alias("hydrogen"))
    both = bonds.union(topology.bonds.select("atom_j", "atom_i"))
    d = element.where("element in (7, 8)").select(F.col("atom_index").alias("donor"))
    h = element.where("element = 1").select(F.col("atom_index").alias("hydrogen"))
    return both.join(d, "donor", "left_semi").join(h, "hydrogen", "left_semi").select("donor", "hydrogen").distinct()


class HydrogenBonds:
    """What a topology says of hydrogen bonds: donors with their hydrogens (none without any bonds), acceptors and elements."""

    def __init__(self, topology: Topology, distance: float = 2.5, angle: float = 120.0):
        self.distance, self.angle, self.elements = distance, angle, _elements(topology)
        self.acceptors = np.flatnonzero(np.isin(self.elements, (7, 8, 16)))
        pairs = None if topology.bonds.isEmpty() else sorted(tuple(r) for r in donor_hydrogens(topology).collect())
        self.arms = None if pairs is None else np.array(pairs, np.int64).reshape(-1, 2)

    def of(self, points: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """(frame, donor, hydrogen, acceptor, distance, angle in degrees) of some frames' bonds."""
        if self.arms is None:
            frame, donor, hydrogen = donors_near(points, self.elements, 1.3)
        else:
            frame = np.repeat(np.arange(len(points)), len(self.arms))
            donor, hydrogen = np.tile(self.arms, (len(points), 1)).T
        ends = points[frame, hydrogen]
        own, q, q_frame = _chosen(points, self.acceptors)
        for a, b, d in pairs_between(ends, frame, q, q_frame, self.distance, inclusive=True):
            acceptor = own[b % max(1, len(own))]
            arm, out = points[frame[a], donor[a]] - ends[a], q[b] - ends[a]
            sizes = np.sqrt((arm**2).sum(1)), np.sqrt((out**2).sum(1))
            kept = (acceptor != donor[a]) & (acceptor != hydrogen[a]) & (sizes[0] >= 1e-10) & (sizes[1] >= 1e-10)
            cosine = (arm * out).sum(1)[kept] / (sizes[0] * sizes[1])[kept]
            bent = np.degrees(np.arccos(np.clip(cosine, -1, 1)))
            a, acceptor, d = a[kept], acceptor[kept], d[kept]
            wide = bent >= self.angle
            yield frame[a[wide]], donor[a[wide]], hydrogen[a[wide]], acceptor[wide], d[wide], bent[wide]

    def counts(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), np.int64)
        for frame, *_ in self.of(points):
            out += np.bincount(frame, minlength=len(points))
        return out


def hydrogen_bonds(frames: DataFrame, topology: Topology, distance: float = 2.5, angle: float = 120.0) -> DataFrame:
    """frame, donor, hydrogen, acceptor, distance, angle (degrees).

    Donors are N or O bonded to a hydrogen, acceptors N, O or S other than the donor; H-A at most
    ``distance`` and D-H-A at least ``angle``. Without any bonds, donors come from distances.
    """
    names, bonds = ("donor", "hydrogen", "acceptor", "distance", "angle"), HydrogenBonds(topology, distance, angle)

    def found(points: np.ndarray) -> Found:
        for frame, *values in bonds.of(points):
            yield frame, dict(zip(names, values))

    return rows_of_frames(frames, "donor int, hydrogen int, acceptor int, distance double, angle double", found)


def hydrogen_bond_counts(frames: DataFrame, topology: Topology, distance: float = 2.5, angle: float = 120.0) -> DataFrame:
    """frame, n_hbonds; 0 for frames without."""
    bonds = HydrogenBonds(topology, distance, angle)
    return per_frame(frames, "n_hbonds bigint", lambda points: {"n_hbonds": bonds.counts(points)})


def counts_by_frame(frames: DataFrame, found: DataFrame, name: str) -> DataFrame:
    """frame and how many rows it has; 0 for frames without."""
    k = keys(frames)
    return frames.select(*k).join(found.groupBy(*k).agg(F.count("*").alias(name)), k, "left").select(*k, F.coalesce(name, F.lit(0)).alias(name))


def _volume() -> Column:
    """Of a frame's own box; one without volume, or no box at all, fails."""
    a, b, c = (tuple(F.get("box", F.lit(3 * i + j)).cast("double") for j in range(3)) for i in range(3))
    v = F.abs(V.dot(a, V.cross(b, c)))
    return F.when(v > 0, v).otherwise(F.raise_error(F.lit("box without volume")).cast("double"))


def box_volume(frames: DataFrame) -> DataFrame:
    """frame, volume in Å^3 of frames with a box; a box without volume fails."""
    return frames.where("box is not null").select(*keys(frames), _volume().alias("volume"))


def rdf(frames: DataFrame, first: list[int], second: list[int], volume: float | None = None, r_min: float = 0.0, r_max: float = 10.0, bins: int = 100) -> DataFrame:
    """frame, bin, r, g_r: distances between the selections by shell, over what an even density gives.

    The density is that of the frame's own box, which it must have, or of one ``volume``. Every pair
    counts, of an atom with itself as well; without minimum images.
    """
    k = keys(frames)
    width = (r_max - r_min) / bins
    low = r_min + np.arange(bins) * width
    shell = 4.0 / 3.0 * np.pi * ((low + width) ** 3 - low**3)

    def density(points: np.ndarray, volumes: pa.Array) -> dict:
        n = np.zeros(len(points) * bins, np.int64)
        for frame, _, _, d in pairs_of(points, first, second, r_max):
            place = np.floor((d - r_min) / width).astype(np.int64)
            own = (d >= r_min) & (place < bins)
            n += np.bincount(frame[own] * bins + place[own], minlength=len(n))
        even = len(second) / volumes.to_numpy(zero_copy_only=False)[:, None] * len(first) * shell
        return {"g": lists(n.reshape(-1, bins) / even)}

    own = frames.withColumn("volume", _volume() if volume is None else F.lit(float(volume)))
    each = per_frame(own, "g array<double>", density, ("volume",)).select(*k, F.posexplode("g").alias("bin", "g_r"))
    return each.select(*k, "bin", (r_min + F.col("bin") * width + width / 2).alias("r"), "g_r")


def rdf_average(frames: DataFrame, first: list[int], second: list[int], volume: float | None = None, r_min: float = 0.0, r_max: float = 10.0, bins: int = 100) -> DataFrame:
    """bin, r, g_r: the mean of the frames' g(r)."""
    return rdf(frames, first, second, volume, r_min, r_max, bins).groupBy("bin").agg(F.first("r").alias("r"), F.avg("g_r").alias("g_r"))


def native_pairs(reference: tuple, a: list[int], b: list[int], cutoff: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (i in a, j in b) of one reference frame within the cutoff, and their distance r0."""
    parts = list(pairs_of(np.array(reference, float).T[None], a, b, cutoff, inclusive=True))
    i, j, r0 = (np.concatenate([p[c] for p in parts]) if parts else np.zeros(0, np.int64) for c in (1, 2, 3))
    return i, j, r0


def native_contacts(frames: DataFrame, reference: tuple, a: list[int], b: list[int], cutoff: float = 4.5, beta: float | None = None, scale: float = 1.8) -> DataFrame:
    """frame, value: the share of the reference's contacts that a frame still has; 0 if there are none.

    With ``beta`` a contact counts 1 / (1 + exp(beta (r - scale r0))) instead of 0 or 1. Native pairs
    are found once, and go to the tasks as arrays; each frame looks at those alone.
    """
    i, j, r0 = native_pairs(reference, a, b, cutoff)

    def share(points: np.ndarray) -> dict:
        value = np.zeros(len(points))
        for k in range(len(points) if len(i) else 0):
            r = np.sqrt(((points[k, i] - points[k, j]) ** 2).sum(1))
            with np.errstate(over="ignore"):
                value[k] = (r <= cutoff).mean() if beta is None else (1 / (1 + np.exp(beta * (r - scale * r0)))).mean()
        return {"value": value}

    return per_frame(frames, "value double", share)
