"""Periodic boxes: wrapping, nearest images, and molecules made whole.

A box is nine numbers, rows a, b, c: one for all frames, or where none is given each frame's own from
its column box. A frame without a box, or with one without extent, fails.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajix.functions.points import lists, per_frame
from trajix.model import keys, listed

Box = list[float]


def is_orthorhombic(box: Box) -> bool:
    return all(abs(v) < 1e-6 for i, v in enumerate(box) if i % 4)


def _columns(box: Box | None) -> list[Column]:
    """The nine numbers as columns; the diagonal ones fail where they are no lengths."""
    if box is not None:
        if min(box[0], box[4], box[8]) <= 0:
            raise ValueError("InvalidBox")
        return [F.lit(float(v)) for v in box]
    own = [F.get("box", F.lit(k)).cast("double") for k in range(9)]
    sound = (own[0] > 0) & (own[4] > 0) & (own[8] > 0)
    return [F.when(sound, v).otherwise(F.raise_error(F.lit("InvalidBox")).cast("double")) if k % 4 == 0 else v for k, v in enumerate(own)]


def _whole_turns(point: list[Column], box: Box | None, turns) -> list[Column]:
    """Take box vectors off a point, c first, then b, then a, as often as ``turns`` of the coordinate says."""
    b = _columns(box)
    for row in (2, 1, 0):
        n = turns(point[row] / b[4 * row])
        point = [p - n * b[3 * row + c] if box is None or box[3 * row + c] else p for c, p in enumerate(point)]
    return point


def wrap(coords: DataFrame, box: Box | None = None) -> DataFrame:
    """Long rows with each point moved into the box."""
    moved = _whole_turns([F.col(c) for c in "xyz"], box, lambda q: F.floor(q).cast("double"))
    return coords.withColumns(dict(zip("xyz", moved)))


def nearest_image(delta: list[Column], box: Box | None = None) -> list[Column]:
    """The difference of two points, to the nearest image; halves round away from zero. Not exact for very skewed boxes."""
    return _whole_turns(delta, box, lambda q: F.round(q).cast("double"))


def image_distances(frames: DataFrame, pairs: list[tuple[int, int]], box: Box | None = None) -> DataFrame:
    """frame, pair, value: nearest-image distances between atoms of wide frames."""
    rows = [{"n": n, "i": i, "j": j} for n, (i, j) in enumerate(pairs)]
    own = ["box"] if box is None else []
    each = frames.select(*keys(frames), *own, *"xyz", F.explode(listed(rows, "array<struct<n:int,i:int,j:int>>")).alias("t"))
    delta = nearest_image([F.get(c, F.col("t.j")).cast("double") - F.get(c, F.col("t.i")).cast("double") for c in "xyz"], box)
    return each.select(*keys(frames), F.col("t.n").alias("pair"), F.sqrt(sum((d * d for d in delta[1:]), delta[0] * delta[0])).alias("value"))


def spanning_steps(bonds: list[tuple[int, int]], n_atoms: int) -> list[tuple[list[int], list[int]]]:
    """Steps of a breadth-first walk of every molecule from its lowest atom: atoms and, for each, the one it was reached from."""
    near: dict[int, list[int]] = {}
    for i, j in bonds:
        near.setdefault(i, []).append(j)
        near.setdefault(j, []).append(i)
    seen, steps = [False] * n_atoms, []
    for root in range(n_atoms):
        if seen[root]:
            continue
        seen[root], level, depth = True, [root], 0
        while level:
            nodes, parents = [], []
            for atom in level:
                for other in near.get(atom, []):
                    if not seen[other]:
                        seen[other] = True
                        nodes.append(other)
                        parents.append(atom)
            if nodes:
                if depth == len(steps):
                    steps.append(([], []))
                steps[depth][0].extend(nodes)
                steps[depth][1].extend(parents)
            level, depth = nodes, depth + 1
    return steps


def make_whole(frames: DataFrame, bonds: list[tuple[int, int]], n_atoms: int, box: Box | None = None) -> DataFrame:
    """Wide frames with every molecule in one piece: an atom lies at its molecule's lowest atom plus the
    nearest images of the bonds that lead to it. Without bonds, or under two atoms, frames stay as they are.

    Atoms are placed in the order of a breadth-first walk, all molecules of some frames together.
    """
    if not bonds or n_atoms < 2:
        return frames.select(*keys(frames), *"xyz")
    _columns(box)
    steps = [(np.array(a), np.array(p)) for a, p in spanning_steps(bonds, n_atoms)]

    def place(points: np.ndarray, boxes: pa.Array | None = None) -> dict:
        if boxes is None:
            b = np.broadcast_to(np.array(box, float).reshape(3, 3), (len(points), 3, 3))
        else:
            if boxes.null_count:
                raise ValueError("InvalidBox")
            b = boxes.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, 3, 3)
            if not (b[:, range(3), range(3)] > 0).all():
                raise ValueError("InvalidBox")
        out = points.copy()
        for atoms, parents in steps:
            delta = points[:, atoms] - points[:, parents]
            for row in (2, 1, 0):
                q = delta[:, :, row] / b[:, None, row, row]
                n = np.copysign(np.floor(np.abs(q) + 0.5), q)
                delta = delta - n[:, :, None] * b[:, None, row]
            out[:, atoms] = out[:, parents] + delta
        return {c: lists(np.ascontiguousarray(out[:, :, i])) for i, c in enumerate("xyz")}

    return per_frame(frames, "x array<double>, y array<double>, z array<double>", place, () if box is not None else ("box",))
