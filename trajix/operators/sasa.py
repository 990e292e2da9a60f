"""Solvent-accessible surface by test points on each atom's sphere, in the task that reads a frame."""

from __future__ import annotations

from math import pi, sqrt

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajix.functions.points import close_pairs, lists, per_frame
from trajix.model import keys, listed

#: Pairs of atoms whose test points are looked at together.
STEP_HIDERS = 1 << 14


def sphere_points(n: int) -> list[dict]:
    """``n`` points of a golden spiral on the unit sphere."""
    from math import cos, sin

    turn, out = pi * (3 - sqrt(5)), []
    for k in range(n):
        z = 1 - (2 * k + 1) / n
        r = sqrt(1 - z * z)
        out.append({"p": k, "x": r * cos(turn * k), "y": r * sin(turn * k), "z": z})
    return out


def areas_of(points: np.ndarray, radii: list[float], atoms: list[int] | None, probe: float, n: int) -> np.ndarray:
    """Areas of some frames' atoms, a row per frame.

    Each test point on the sphere of an atom's radius and the probe is free unless it lies inside the
    sphere of a near atom, which a product of the direction to that atom and the points' tells.
    """
    own = np.arange(points.shape[1]) if atoms is None else np.array(atoms, int)
    r = np.tile((np.array(radii, float) + probe)[own], len(points))
    flat, frame = points[:, own].reshape(-1, 3), np.repeat(np.arange(len(points)), len(own))
    sphere = np.array([[p["x"], p["y"], p["z"]] for p in sphere_points(n)])
    free = np.full(len(flat), n)
    for a, b, d in close_pairs(flat, frame, 2 * r.max(initial=0.1)):
        near = d < r[a] + r[b]
        a, b, d = a[near], b[near], d[near]
        starts = np.flatnonzero(np.append(True, a[1:] != a[:-1])) if len(a) else np.zeros(0, int)
        at = 0
        while at < len(starts):  # whole atoms at a time
            end = max(at + 1, int(np.searchsorted(starts, starts[at] + STEP_HIDERS, "right")) - 1)
            if starts[-1] <= starts[at] + STEP_HIDERS:
                end = len(starts)
            part = slice(starts[at], starts[end] if end < len(starts) else len(a))
            reach = (r[b[part]] ** 2 - r[a[part]] ** 2 - d[part] ** 2) / (2 * r[a[part]])
            hidden = (flat[a[part]] - flat[b[part]]) @ sphere.T < reach[:, None]
            free[a[starts[at:end]]] = n - np.logical_or.reduceat(hidden, starts[at:end] - starts[at]).sum(1)
            at = end
    return (free / n * 4 * pi * r * r).reshape(len(points), len(own))


class MaskTable:
    """Which test points of a sphere lie in the cap around a direction, as bits, for directions and cap sizes on a grid.

    Directions go by ``rings`` bands of equal area of as many sectors, cap sizes by their cosine. A cap is that
    of the cell's middle, so a point within about half a cell of the cap's edge may count wrongly.
    """

    def __init__(self, n: int, rings: int = 48, caps: int = 256):
        self.n, self.rings, self.caps, self.words = n, rings, caps, -(-n // 64)
        sphere = np.array([[p["x"], p["y"], p["z"]] for p in sphere_points(n)])
        z = (np.repeat(np.arange(rings), rings) + 0.5) * 2 / rings - 1
        turn = (np.tile(np.arange(rings), rings) + 0.5) * 2 * pi / rings - pi
        flat = np.sqrt(1 - z * z)
        cosine = np.stack([flat * np.cos(turn), flat * np.sin(turn), z], axis=1) @ sphere.T
        level = np.clip(np.ceil((cosine + 1) * caps / 2 - 0.5), 0, caps).astype(int)  # a cap of a lower level has the point
        self.masks = np.zeros((rings * rings, caps + 1, self.words), np.uint64)
        for k in range(n):
            cell = np.flatnonzero(level[:, k])
            self.masks[cell, level[cell, k] - 1, k // 64] |= np.uint64(1 << k % 64)
        self.masks = np.bitwise_or.accumulate(self.masks[:, ::-1], axis=1)[:, ::-1]

    def of(self, towards: np.ndarray, cosine: np.ndarray) -> np.ndarray:
        """Masks of the points whose direction has a cosine above the given ones with some unit vectors."""
        ring = np.clip(((towards[:, 2] + 1) * self.rings / 2).astype(int), 0, self.rings - 1)
        sector = np.clip(((np.arctan2(towards[:, 1], towards[:, 0]) + pi) * self.rings / (2 * pi)).astype(int), 0, self.rings - 1)
        cap = np.clip(np.rint((cosine + 1) * self.caps / 2), 0, self.caps).astype(int)
        return self.masks[ring * self.rings + sector, cap]


_tables: dict[int, MaskTable] = {}


def areas_by_masks(points: np.ndarray, radii: list[float], atoms: list[int] | None, probe: float, n: int) -> np.ndarray:
    """As ``areas_of``, by masks: the hidden points of an atom are the union of its near atoms' caps.

    For at most 1,024 points. Each area is within a few points' share of the plain way's; errors go both ways.
    """
    if n > 1024:
        raise ValueError("masks are for at most 1024 points")
    if n not in _tables:
        _tables[n] = MaskTable(n)
    table = _tables[n]
    own = np.arange(points.shape[1]) if atoms is None else np.array(atoms, int)
    r = np.tile((np.array(radii, float) + probe)[own], len(points))
    flat, frame = points[:, own].reshape(-1, 3), np.repeat(np.arange(len(points)), len(own))
    free = np.full(len(flat), n)
    for a, b, d in close_pairs(flat, frame, 2 * r.max(initial=0.1)):
        near = d < r[a] + r[b]
        a, b, d = a[near], b[near], np.maximum(d[near], 1e-12)
        if not len(a):
            continue
        cosine = (d * d + r[a] ** 2 - r[b] ** 2) / (2 * d * r[a])
        hidden = table.of((flat[b] - flat[a]) / d[:, None], cosine)
        hidden[cosine <= -1] = np.uint64(0xFFFFFFFFFFFFFFFF)  # the whole atom lies inside the other
        starts = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
        bits = np.bitwise_count(np.bitwise_or.reduceat(hidden, starts, axis=0)).sum(1)
        free[a[starts]] = n - np.minimum(bits, n)
    return (free / n * 4 * pi * r * r).reshape(len(points), len(own))


def sasa(frames: DataFrame, radii: list[float], atoms: list[int] | None = None, probe: float = 1.4, points: int = 100, masks: bool = False) -> DataFrame:
    """frame, atom_index, area in Å^2 of the atoms (all, or a subset that also alone hides points); nearly so by ``masks``, which is faster."""
    areas = areas_by_masks if masks else areas_of
    found = per_frame(frames, "area array<double>", lambda p: {"area": lists(areas(p, radii, atoms, probe, points))})
    each = found.select(*keys(frames), F.posexplode("area").alias("k", "area"))
    index = F.col("k") if atoms is None else F.get(listed(atoms, "array<int>"), F.col("k"))
    return each.select(*keys(frames), index.alias("atom_index"), "area")


def total(areas: DataFrame) -> DataFrame:
    """frame, area over all its atoms."""
    return areas.groupBy(*keys(areas)).agg(F.sum("area").alias("area"))


def total_by_frame(frames: DataFrame, radii: list[float], atoms: list[int] | None = None, probe: float = 1.4, points: int = 100, masks: bool = False) -> DataFrame:
    """frame, area over all its atoms, summed where the frame is read."""
    areas = areas_by_masks if masks else areas_of
    return per_frame(frames, "area double", lambda p: {"area": areas(p, radii, atoms, probe, points).sum(1)})
