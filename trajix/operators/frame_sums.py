"""Values of a frame that sum over its atoms: centers, radius of gyration, inertia.

Atoms are summed in the task that reads the frame, for many frames at once, first to the center and
then about it; nothing moves but the results.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajix.functions.points import per_frame
from trajix.model import keys


def about_center(points: np.ndarray, weights: list[float] | None, atoms: list[int] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights and their sum's inverse (0 if there is none), centers, and the atoms from them, of some frames."""
    own = np.arange(points.shape[1]) if atoms is None else np.array(atoms, int)
    w = np.ones(len(own)) if weights is None else np.array(weights, float)[own]
    w = w / w.sum() if w.sum() else np.zeros(len(own))
    chosen = points[:, own]
    first = chosen[:, :1] if len(own) else np.zeros((len(points), 1, 3))
    center = first[:, 0] + np.einsum("a,fac->fc", w, chosen - first) if w.any() else np.zeros((len(points), 3))
    return w, center, chosen - center[:, None]


def center(frames: DataFrame, weights: list[float] | None = None, atoms: list[int] | None = None) -> DataFrame:
    """frame, cx, cy, cz: center of mass with weights, of geometry without; 0 where the weights are."""
    return per_frame(frames, "cx double, cy double, cz double", lambda p: dict(zip(("cx", "cy", "cz"), np.ascontiguousarray(about_center(p, weights, atoms)[1].T))))


def gyration(points: np.ndarray, weights: list[float] | None, atoms: list[int] | None) -> np.ndarray:
    w, _, d = about_center(points, weights, atoms)
    return np.sqrt(np.einsum("a,fac,fac->f", w, d, d))


def radius_of_gyration(frames: DataFrame, weights: list[float] | None = None, atoms: list[int] | None = None) -> DataFrame:
    """frame, value: weighted root mean square distance from the center; 0 where the weights are."""
    return per_frame(frames, "value double", lambda p: {"value": gyration(p, weights, atoms)})


def inertia(frames: DataFrame, weights: list[float], atoms: list[int] | None = None) -> DataFrame:
    """frame and the tensor about the center of mass: ixx, iyy, izz, ixy, ixz, iyz."""
    mass = sum(weights if atoms is None else [weights[i] for i in atoms])

    def tensor(points: np.ndarray) -> dict:
        w, _, d = about_center(points, weights, atoms)
        m = mass * np.einsum("a,fai,faj->fij", w, d, d)
        x, y, z = m[:, 0, 0], m[:, 1, 1], m[:, 2, 2]
        return {"ixx": y + z, "iyy": x + z, "izz": x + y, "ixy": 0.0 - m[:, 0, 1], "ixz": 0.0 - m[:, 0, 2], "iyz": 0.0 - m[:, 1, 2]}

    return per_frame(frames, ", ".join(f"i{p} double" for p in ("xx", "yy", "zz", "xy", "xz", "yz")), tensor)


def principal_moments(tensors: DataFrame) -> DataFrame:
    """frame, i1, i2, i3: eigenvalues of the tensors, ascending.

    The angle of the characteristic cubic comes from the tensor less its mean, scaled to unit size.
    """
    a = {p: F.col(f"i{p}") for p in ("xx", "yy", "zz", "xy", "xz", "yz")}
    mean = (a["xx"] + a["yy"] + a["zz"]) / 3
    dx, dy, dz = a["xx"] - mean, a["yy"] - mean, a["zz"] - mean
    off = a["xy"] * a["xy"] + a["xz"] * a["xz"] + a["yz"] * a["yz"]
    size = F.sqrt((dx * dx + dy * dy + dz * dz + 2 * off) / 6)
    det = dx * (dy * dz - a["yz"] * a["yz"]) - a["xy"] * (a["xy"] * dz - a["yz"] * a["xz"]) + a["xz"] * (a["xy"] * a["yz"] - dy * a["xz"])
    half = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), det / F.nullif(2 * size * size * size, F.lit(0.0))))
    turn = F.acos(half) / 3
    third = 2 * F.lit(3.141592653589793) / 3
    k = keys(tensors)
    roots = F.when(size == 0, F.array(mean, mean, mean)).otherwise(F.array_sort(F.array(*[mean + 2 * size * F.cos(turn + n * third) for n in range(3)])))
    return tensors.select(*k, F.coalesce(roots, F.array(mean, mean, mean)).alias("r")).select(*k, *[F.get("r", F.lit(n)).alias(f"i{n + 1}") for n in range(3)])
