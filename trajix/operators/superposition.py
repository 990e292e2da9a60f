"""Optimal superposition on a reference frame, in the task that reads a frame."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajix.functions.points import lists, per_frame

Reference = tuple[list[float], list[float], list[float]]


def reference_of(frames: DataFrame, frame: int, traj: str | None = None) -> Reference:
    """The coordinates of one frame, for the driver to send along."""
    chosen = frames.where(F.col("frame") == frame)
    row = (chosen.where(F.col("traj") == traj) if traj is not None else chosen).select("x", "y", "z").first()
    if row is None:
        raise ValueError(f"no frame {frame}")
    return tuple([float(v) for v in row[c]] for c in "xyz")


def fitted(points: np.ndarray, reference: Reference, atoms: list[int] | None) -> tuple[np.ndarray, np.ndarray]:
    """Frames moved onto the reference by the proper rotation that fits the atoms best, and their distances from it over these.

    The rotations come from the singular vectors of all frames' inner products at once.
    """
    ref = np.array(reference, float).T.reshape(-1, 3)
    own = np.arange(len(ref)) if atoms is None else np.array(atoms, int)
    if not len(own):
        return points, np.zeros(len(points))
    to = ref[own] - ref[own].mean(0)
    middle = points[:, own].mean(1, keepdims=True)
    u, _, vt = np.linalg.svd(np.einsum("fai,aj->fij", points[:, own] - middle, to))
    u[:, :, 2] *= np.where(np.linalg.det(u @ vt) < 0, -1.0, 1.0)[:, None]
    moved = (points - middle) @ (u @ vt)
    apart = np.sqrt(((moved[:, own] - to) ** 2).sum(2).mean(1))
    return moved + ref[own].mean(0), apart


def rmsd(frames: DataFrame, reference: Reference, atoms: list[int] | None = None) -> DataFrame:
    """frame, value: least root mean square distance from the reference over the atoms, unweighted; 0 without atoms."""
    return per_frame(frames, "value double", lambda p: {"value": fitted(p, reference, atoms)[1]})


def superpose(frames: DataFrame, reference: Reference, atoms: list[int] | None = None) -> DataFrame:
    """The frames moved onto the reference, and rmsd over the fitted atoms; every atom moves with them.

    Rotations are proper. Without atoms to fit, frames keep their place; with none that fix a
    rotation, one of the best.
    """

    def move(points: np.ndarray) -> dict:
        moved, apart = fitted(points, reference, atoms)
        return {**{c: lists(np.ascontiguousarray(moved[:, :, i])) for i, c in enumerate("xyz")}, "rmsd": apart}

    return per_frame(frames, "x array<double>, y array<double>, z array<double>, rmsd double", move)
