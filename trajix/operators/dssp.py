"""Secondary structure from backbone hydrogen bonds, in the task that reads a frame.

Hydrogens, breaks, torsions, near residues, energies, each donor's two best acceptors, bridges, helices,
turns, bends and stretches come from arrays of many frames at once. What is left per frame, the assembly
of ladders and sheets, works on the few bridges of a frame.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajix.functions.points import close_pairs, per_frame, rows_of_frames
from trajix.model import keys, listed
from trajix.operators.geometry import _residue_atoms

# Fixed values of the method: energies in kcal/mol, lengths in Å, angles in degrees.
COUPLING, LOWEST, BOND_BELOW, TOO_NEAR = -27.888, -9.9, -0.5, 0.5
PEPTIDE_BOND, NEAR_CA, BEND_ABOVE = 2.5, 9.0, 70.0
PP_PHI, PP_PSI, PP_SLACK, PP_STRETCH = -75.0, 145.0, 29.0, 3


class NoCompleteResidues(ValueError):
    pass


def complete_residues(table: DataFrame) -> list[dict]:
    """Residues of one topology with N, CA, C and O, renumbered in order."""
    own = _residue_atoms(table, ["N", "CA", "C", "O"]).where("N is not null and CA is not null and C is not null and O is not null")
    names = table.groupBy("residue_index").agg(F.first("residue_name").alias("residue_name"))
    rows = own.join(names, "residue_index").orderBy("residue_index").collect()
    if not rows:
        raise NoCompleteResidues
    return [{"r": i, "residue": x["residue_index"], "chain": x["chain_index"], "pro": x["residue_name"] == "PRO", "n": x["N"], "a": x["CA"], "c": x["C"], "o": x["O"]} for i, x in enumerate(rows)]


ANGLES = ("phi", "psi", "omega", "kappa", "alpha", "tco")
RESIDUE = "array<struct<r:int,residue:int,chain:int,segment:int," + ",".join(f"{a}:double" for a in ANGLES) + ">>"
BONDING = f"residues {RESIDUE}, energies array<struct<donor:int,acceptor:int,energy:double>>, best array<struct<donor:int,acceptor:int,energy:double,rank:int>>, pairs array<struct<i:int,j:int>>"


def _norm(v: np.ndarray) -> np.ndarray:
    return np.sqrt((v * v).sum(-1))


def _cosine(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    size = _norm(u) * _norm(v)
    return (u * v).sum(-1) / np.where(size > 0, size, np.nan)


def _torsion(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    axis = c - b
    n1, n2 = np.cross(b - a, axis), np.cross(axis, d - c)
    size = _norm(axis)
    return np.degrees(np.arctan2((np.cross(axis, n1) * n2).sum(-1) / np.where(size > 0, size, np.nan), (n1 * n2).sum(-1)))


def _shifted(v: np.ndarray, by: int, fill) -> np.ndarray:
    """What the residue ``by`` places on has, or ``fill`` beyond the ends."""
    out = np.full_like(v, fill)
    n = v.shape[1]
    if abs(by) < n:
        out[:, max(0, -by) : n - max(0, by)] = v[:, max(0, by) : n - max(0, -by)]
    return out


def _residue_values(n, ca, c, o, chain: np.ndarray, pro: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """Segments between breaks, hydrogens and angles (NaN for none) of (frames, residues, 3) positions."""
    next_of = lambda v, by: _shifted(v, by, np.nan)
    gap = _norm(next_of(c, -1) - n) > PEPTIDE_BOND
    breaks = gap | np.append(False, chain[1:] != chain[:-1])
    breaks[:, :1] = False
    segment = np.cumsum(breaks, axis=1)

    def joined(low: int, high: int) -> np.ndarray:
        """Whether residues low to high from here are there without a break between."""
        return (_shifted(segment, low, -1) == _shifted(segment, high, -2)) & (_shifted(segment, low, -1) >= 0)

    co = next_of(o, -1) - next_of(c, -1)
    length = _norm(co)[..., None]
    has_h = (joined(-1, 0) & ~pro)[..., None]
    h = np.where(~has_h, 0.0, np.where(length < 1e-6, n, n - co / np.where(length > 0, length, 1.0)))
    keep = lambda v, low, high: np.where(joined(low, high), v, np.nan)
    angles = {
        "phi": keep(_torsion(next_of(c, -1), n, ca, c), -1, 0),
        "psi": keep(_torsion(n, ca, c, next_of(n, 1)), 0, 1),
        "omega": keep(_torsion(ca, c, next_of(n, 1), next_of(ca, 1)), 0, 1),
        "kappa": keep(np.degrees(np.arccos(np.clip(_cosine(ca - next_of(ca, -2), next_of(ca, 2) - ca), -1, 1))), -2, 2),
        "alpha": keep(_torsion(next_of(ca, -1), ca, next_of(ca, 1), next_of(ca, 2)), -1, 2),
        "tco": keep(_cosine(c - o, next_of(c - o, -1)), -1, 0),
    }
    return segment, h, angles


def _records(columns: dict[str, np.ndarray], frame: np.ndarray, n_frames: int) -> pa.ListArray:
    """Rows in the order of frames as a list of structs per frame; NaN is null."""
    arrays = [pa.array(v, mask=np.isnan(v)) if v.dtype.kind == "f" else pa.array(v.astype(np.int32)) for v in columns.values()]
    first = np.searchsorted(frame, np.arange(n_frames + 1))
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.StructArray.from_arrays(arrays, names=list(columns)))


@dataclass(frozen=True)
class _Bonding:
    """Segments (frames, residues), angles, and pairs of residues counted through all frames (frame * residues + r):
    near ones with their energies, unless left out, and each donor's two best."""

    segment: np.ndarray
    angles: dict[str, np.ndarray]
    donor: np.ndarray
    acceptor: np.ndarray
    energy: np.ndarray
    best: dict[str, np.ndarray]


def _energy(n: np.ndarray, h: np.ndarray, c: np.ndarray, o: np.ndarray) -> np.ndarray:
    """Of bonds from a donor's N and H to an acceptor's C and O, (pairs, 3) each."""
    ho, hc, nc, no = (_norm(u - v) for u, v in ((h, o), (h, c), (n, c), (n, o)))
    with np.errstate(divide="ignore", invalid="ignore"):
        terms = 1000 * (COUPLING / ho - COUPLING / hc + COUPLING / nc - COUPLING / no)
        rounded = np.copysign(np.floor(np.abs(terms) + 0.5), terms) / 1000
    near = np.minimum.reduce([ho, hc, nc, no]) < TOO_NEAR
    return np.where(near, LOWEST, np.maximum(rounded, LOWEST))


def _bonding(points: np.ndarray, at: dict[str, np.ndarray], chain: np.ndarray, pro: np.ndarray, every: bool = True) -> _Bonding:
    """Near pairs are weighed in steps, each with all pairs of its donors; without ``every`` only the best outlive a step."""
    n, ca, c, o = (points[:, at[p]] for p in "naco")
    with np.errstate(invalid="ignore"):
        segment, h, angles = _residue_values(n, ca, c, o, chain, pro)
    f, m = segment.shape
    n, h, c, o = (v.reshape(-1, 3) for v in (n, h, c, o))
    none = (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    all_, best = [none], [(*none, np.zeros(0, int))]
    for d, a, _ in close_pairs(ca.reshape(-1, 3), np.repeat(np.arange(f), m), NEAR_CA):
        far = abs(d - a) >= 2
        d, a = d[far], a[far]
        energy = np.where(pro[d % m], 0.0, _energy(n[d], h[d], c[a], o[a]))
        if every:
            all_.append((d, a, energy))
        by = np.lexsort((a, energy, d))
        by = by[energy[by] < 0]
        fresh = np.append(True, d[by][1:] != d[by][:-1]) if len(by) else np.zeros(0, bool)
        rank = np.arange(len(by)) - np.maximum.accumulate(np.where(fresh, np.arange(len(by)), 0)) + 1
        by, rank = by[rank <= 2], rank[rank <= 2]
        best.append((d[by], a[by], energy[by], rank))
    d, a, energy = (np.concatenate(v) for v in zip(*all_))
    order = np.lexsort((a, d))
    found = dict(zip(("donor", "acceptor", "energy", "rank"), (np.concatenate(v) for v in zip(*best))))
    first = np.lexsort((found["rank"], found["donor"]))
    return _Bonding(segment, angles, d[order], a[order], energy[order], {k: v[first] for k, v in found.items()})


def _of_residues(residues: list[dict]) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Atoms by name, residue numbers, chains and whether a residue has no hydrogen."""
    return {p: np.array([x[p] for x in residues]) for p in "naco"}, *(np.array([x[c] for x in residues]) for c in ("residue", "chain", "pro"))


def bonding(frames: DataFrame, residues: list[dict]) -> DataFrame:
    """A frame's complete residues with their segments and angles, near pairs i + 2 <= j (CA nearer than
    9 Å), energies of these both ways, and each donor's two acceptors of lowest energy below 0, ties to
    the earlier residue. All of it comes from the frame alone; no row moves.
    """
    at, number, chain, pro = _of_residues(residues)

    def work(points: np.ndarray) -> dict:
        x = _bonding(points, at, chain, pro)
        f, m = x.segment.shape
        own = {"r": np.tile(np.arange(m), f), "residue": np.tile(number, f), "chain": np.tile(chain, f), "segment": x.segment.ravel(), **{a: x.angles[a].ravel() for a in ANGLES}}
        d, a, b, once = x.donor, x.acceptor, x.best, x.donor < x.acceptor
        return {
            "residues": _records(own, np.repeat(np.arange(f), m), f),
            "energies": _records({"donor": d % m, "acceptor": a % m, "energy": x.energy}, d // m, f),
            "best": _records(b | {"donor": b["donor"] % m, "acceptor": b["acceptor"] % m}, b["donor"] // m, f),
            "pairs": _records({"i": d[once] % m, "j": a[once] % m}, d[once] // m, f),
        }

    return per_frame(frames, BONDING, work)


def energies(bonded: DataFrame) -> DataFrame:
    """frame, donor, acceptor, energy of near residues, both ways."""
    return bonded.select(*keys(bonded), F.explode("energies").alias("e")).select(*keys(bonded), "e.*")


def best_two(bonded: DataFrame) -> DataFrame:
    """frame, donor, acceptor, energy, rank (1 or 2)."""
    return bonded.select(*keys(bonded), F.explode("best").alias("e")).select(*keys(bonded), "e.*")


class _Ladder:
    def __init__(self, parallel: bool, i: int, j: int):
        self.parallel, self.i, self.j = parallel, [i], [j]

    def next(self) -> tuple[bool, int, int]:
        return self.parallel, self.i[-1] + 1, self.j[-1] + 1 if self.parallel else self.j[0] - 1

    def take(self, i: list[int], j: list[int]) -> None:
        self.i += i
        self.j = self.j + j if self.parallel else j + self.j


def _facing(bonds: tuple[np.ndarray, np.ndarray], ca: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Near pairs i + 2 <= j of which a bridge could be made of these bonds: each way to make one has a bond from i or i + 1 to j or j - 1."""
    f, m = ca.shape[:2]
    i, j = (np.concatenate(v) for v in zip(*[(bonds[0] - k, bonds[1] + l) for k in (0, 1) for l in (0, 1)]))
    own = (i >= 0) & (j < f * m) & (i // m == j // m) & (j - i >= 2)
    i, j = np.divmod(np.unique(i[own] * (f * m) + j[own]), f * m)
    points = ca.reshape(-1, 3)
    near = np.sqrt(((points[i] - points[j]) ** 2).sum(1)) < NEAR_CA
    return i[near], j[near]


def _bridges(segment: np.ndarray, bonds: tuple[np.ndarray, np.ndarray], pairs: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs that are bridges, in order, and whether they are parallel; residues are counted through all frames."""
    f, m = segment.shape
    key = np.unique(bonds[0] * (f * m) + bonds[1])
    inner = np.zeros((f, m), bool)
    inner[:, 1:-1] = segment[:, :-2] == segment[:, 2:]
    i, j = pairs
    both = inner.ravel()[i] & inner.ravel()[j]
    i, j = i[both], j[both]
    order = np.lexsort((j, i))
    i, j = i[order], j[order]
    has = lambda d, a: np.isin(d * (f * m) + a, key)
    parallel = (has(i + 1, j) & has(j, i - 1)) | (has(j + 1, i) & has(i, j - 1))
    other = (has(i + 1, j - 1) & has(j + 1, i - 1)) | (has(j, i) & has(i, j))
    return i[parallel | other], j[parallel | other], parallel[parallel | other]


def _ladders(bridges: list[tuple[int, int, bool]], chains: list[int], segment: list[int]) -> list[_Ladder]:
    whole = lambda i, j: segment[i] == segment[j]
    out: list[_Ladder] = []
    wanted: dict[tuple[bool, int, int], _Ladder] = {}
    for i, j, parallel in bridges:
        ladder = wanted.pop((parallel, i, j), None)
        if ladder:
            ladder.take([i], [j])
        else:
            ladder = _Ladder(parallel, i, j)
            out.append(ladder)
        wanted[ladder.next()] = ladder
    out.sort(key=lambda x: (chains[x.i[0]], x.i[0], -len(x.i), x.j[0]))
    at_ = 0
    while at_ < len(out):  # ladders on both sides of a bulge become one
        a, later = out[at_], out[at_ + 1 :]
        for b in later:
            if _bulge(a, b, whole):
                a.take(b.i, b.j)
                out.remove(b)
        at_ += 1
    return out


def _bulge(a: _Ladder, b: _Ladder, whole) -> bool:
    if a.parallel != b.parallel or b.i[0] - a.i[-1] >= 6 or (a.i[-1] >= b.i[0] and a.i[0] <= b.i[-1]):
        return False
    if not whole(min(a.i[0], b.i[0]), max(a.i[-1], b.i[-1])) or not whole(min(a.j[0], b.j[0]), max(a.j[-1], b.j[-1])):
        return False
    gap = b.j[0] - a.j[-1] if a.parallel else a.j[0] - b.j[-1]
    return 0 <= gap < 3 or (0 <= gap < 6 and 0 < b.i[0] - a.i[-1] < 3)


def _strands(bridges: list[tuple[int, int, bool]], chains: list[int], segment: list[int], code: np.ndarray, sheet: np.ndarray, strand: np.ndarray) -> None:
    """Fill a frame's codes of bridges and ladders, sheets and strands."""
    ladders = _ladders(bridges, chains, segment)
    group = list(range(len(ladders)))  # ladders that share a residue are one sheet, numbered by its first ladder
    members = [{*x.i, *x.j} for x in ladders]
    for x in range(len(ladders)):
        for y in range(x):
            if group[x] != group[y] and members[x] & members[y]:
                low, high = sorted((group[x], group[y]))
                group = [low if g == high else g for g in group]
    number = {g: s for s, g in enumerate(dict.fromkeys(sorted(group)), 1)}
    for ladder, g in zip(ladders, group):
        mark = "E" if len(ladder.i) > 1 else "B"
        for side in (ladder.i, ladder.j):
            own = slice(min(side[0], side[-1]), max(side[0], side[-1]) + 1)
            code[own] = np.where(code[own] == "E", "E", mark)
            sheet[own] = number[g]
    count = 0
    for s in number.values():
        at = np.flatnonzero(sheet == s)
        strand[at] = count + 1 + np.cumsum(np.diff(at, prepend=at[:1]) > 1)
        count = strand[at[-1]] if len(at) else count


def _from(starts: np.ndarray, length: int, first: int = 0) -> np.ndarray:
    """Residues ``first`` to ``length`` - 1 places after a start."""
    out = np.zeros_like(starts)
    for k in range(first, length):
        out[:, k:] |= starts[:, : max(0, starts.shape[1] - k)]
    return out


def _all_of(fit: np.ndarray, length: int) -> np.ndarray:
    """Whether this residue and the next ones, ``length`` together, are there and fit."""
    out = fit.copy()
    for k in range(1, length):
        out &= _shifted(fit, k, False)
    return out


def assign_frames(
    chains: np.ndarray, segment: np.ndarray, bonds: tuple[np.ndarray, np.ndarray], pairs: tuple[np.ndarray, np.ndarray], kappa: np.ndarray, phi: np.ndarray, psi: np.ndarray, prefer_pi: bool = True
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, sheets and strands (0 for none), each (frames, residues). Bonds (donor, acceptor) and near pairs count
    residues through all frames; angles are NaN where there is none."""
    f, m = segment.shape
    code, sheet, strand = np.full((f, m), " "), np.zeros((f, m), np.int32), np.zeros((f, m), np.int32)
    if not m:
        return code, sheet, strand
    i, j, parallel = _bridges(segment, bonds, pairs)
    owner = i // m
    for k in np.unique(owner):
        own = slice(*np.searchsorted(owner, [k, k + 1]))
        _strands(list(zip((i[own] % m).tolist(), (j[own] % m).tolist(), parallel[own].tolist())), chains, segment[k], code[k], sheet[k], strand[k])
    starts = {}
    for d in (3, 4, 5):
        at = bonds[1][(bonds[0] - bonds[1] == d) & (bonds[0] // m == bonds[1] // m)]
        starts[d] = np.zeros((f, m), bool)
        starts[d].ravel()[at] = True
        starts[d] &= segment == _shifted(segment, d, -1)
    for d, mark, over in ((4, "H", None), (3, "G", " "), (5, "I", " H" if prefer_pi else " ")):
        turns = starts[d] & _shifted(starts[d], -1, False)
        if over is not None:
            turns &= _all_of(np.isin(code, list(over)), d)
        code[_from(turns, d)] = mark
    ends = np.zeros((f, m), bool)
    ends[:, [0, -1]] = True
    turn = np.logical_or.reduce([_from(starts[d], d, 1) for d in starts])
    with np.errstate(invalid="ignore"):
        bend = kappa > BEND_ABOVE
        inside = (abs(phi - PP_PHI) <= PP_SLACK) & (abs(psi - PP_PSI) <= PP_SLACK)
    code = np.where((code == " ") & ~ends, np.where(turn, "T", np.where(bend, "S", " ")), code)
    return np.where((code == " ") & _from(_all_of(inside & ~ends, PP_STRETCH), PP_STRETCH), "P", code), sheet, strand


def dssp(frames: DataFrame, table: DataFrame, prefer_pi: bool = True) -> DataFrame:
    """frame, residue_index, code, sheet, strand, phi, psi, omega, kappa, alpha, tco of every complete residue."""
    at, number, chain, pro = _of_residues(complete_residues(table))

    def work(points: np.ndarray):
        x = _bonding(points, at, chain, pro, every=False)
        f, m = x.segment.shape
        strong = x.best["energy"] < BOND_BELOW
        bonds = x.best["donor"][strong], x.best["acceptor"][strong]
        found = assign_frames(chain, x.segment, bonds, _facing(bonds, points[:, at["a"]]), *(x.angles[a] for a in ("kappa", "phi", "psi")), prefer_pi)
        own = dict(zip(("code", "sheet", "strand"), (v.ravel() for v in found)))
        angles = {a: pa.array(v.ravel(), mask=np.isnan(v.ravel())) for a, v in x.angles.items()}
        yield np.repeat(np.arange(f), m), {"residue_index": np.tile(number, f), **own, **angles}

    columns = "residue_index int, code string, sheet int, strand int, " + ", ".join(f"{a} double" for a in ANGLES)
    return rows_of_frames(frames, columns, work)


def dssp_strings(found: DataFrame) -> DataFrame:
    """frame and its codes as one text, by residue."""
    rows = found.groupBy(*keys(found)).agg(F.sort_array(F.collect_list(F.struct("residue_index", "code"))).alias("r"))
    return rows.select(*keys(found), F.array_join(F.col("r.code"), "").alias("codes"))


def every_residue(found: DataFrame, table: DataFrame) -> DataFrame:
    """frame, residue_index, code of all residues of the topology, blank where incomplete."""
    k = keys(found)
    all_ = [r[0] for r in table.select("residue_index").distinct().orderBy("residue_index").collect()]
    rows = found.groupBy(*k).agg(F.collect_list(F.struct("residue_index", F.coalesce("code", F.lit(" ")).alias("code"))).alias("r"))
    lost = F.transform(F.array_except(listed(all_, "array<int>"), "r.residue_index"), lambda i: F.struct(i.alias("residue_index"), F.lit(" ").alias("code")))
    return rows.select(*k, F.inline(F.concat("r", lost))).where(F.col("residue_index").isin(all_))
