"""Analyses as table functions of SQL, over a table of wide frames (traj, frame, x, y, z).

    SELECT * FROM frame_rmsd(TABLE(frames) PARTITION BY traj ORDER BY frame)
    SELECT * FROM frame_neighbours(TABLE(SELECT traj, frame, x, y, z FROM frames), 3.0D)

They are Arrow functions: a call gets a batch of rows and works on all of its frames at once, as the
DataFrame operators do. Without PARTITION BY no row moves; frame_rmsd needs a trajectory's rows together and in
order, since its reference is their first. Constants come as arrays of equal values.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udtf

from trajix.functions.points import runs
from trajix.operators import frame_sums, spatial, superposition
from trajix.operators.selection import parse_tuples


def _made(batch: pa.RecordBatch, at: int, end: int, owner: np.ndarray | None, values: dict) -> pa.Table:
    own = [batch[c].slice(at, end - at) for c in ("traj", "frame")]
    if owner is not None:
        own = [c.take(pa.array(owner)) for c in own]
    return pa.table({"traj": own[0], "frame": own[1], **values})


class FrameRmsd:
    """traj, frame, value: least distance from the first frame of the partition over all atoms."""

    columns = "traj string, frame bigint, value double"

    def __init__(self):
        self.reference = None

    def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
        for at, end, points in runs(batch):
            if self.reference is None:
                self.reference = tuple(points[0].T)
            yield _made(batch, at, end, None, {"value": superposition.fitted(points, self.reference, None)[1]})


class FrameGyration:
    """traj, frame, value: radius of gyration, weighted by an array of masses (null: evenly)."""

    columns = "traj string, frame bigint, value double"

    def eval(self, batch: pa.RecordBatch, masses: pa.Array) -> Iterator[pa.Table]:
        weights = masses[0].as_py() if len(masses) else None
        for at, end, points in runs(batch):
            yield _made(batch, at, end, None, {"value": frame_sums.gyration(points, weights, None)})


class FrameDistances:
    """traj, frame, i, j, distance of the pairs of a text such as '0-1,3-17'."""

    columns = "traj string, frame bigint, i int, j int, distance double"

    def eval(self, batch: pa.RecordBatch, pairs: pa.Array) -> Iterator[pa.Table]:
        tuples = np.array(parse_tuples(pairs[0].as_py(), 2) if len(pairs) else [], np.int32).reshape(-1, 2)
        for at, end, points in runs(batch):
            n = end - at
            d = np.sqrt(((points[:, tuples[:, 0]] - points[:, tuples[:, 1]]) ** 2).sum(2))
            yield _made(batch, at, end, np.repeat(np.arange(n), len(tuples)), {"i": np.tile(tuples[:, 0], n), "j": np.tile(tuples[:, 1], n), "distance": d.ravel()})


class FrameNeighbours:
    """traj, frame, i, j, distance of atoms i < j nearer than a cutoff."""

    columns = "traj string, frame bigint, i int, j int, distance double"

    def eval(self, batch: pa.RecordBatch, cutoff: pa.Array) -> Iterator[pa.Table]:
        for at, end, points in runs(batch):
            for frame, i, j, d in spatial.pairs_of(points, None, None, float(cutoff[0].as_py())):
                once = i < j
                yield _made(batch, at, end, frame[once], {"i": i[once].astype(np.int32), "j": j[once].astype(np.int32), "distance": d[once]})


FUNCTIONS: dict[str, Callable] = {"frame_rmsd": FrameRmsd, "frame_gyration": FrameGyration, "frame_distances": FrameDistances, "frame_neighbours": FrameNeighbours}


def register(spark: SparkSession) -> None:
    """Make the functions known to a session's SQL."""
    for name, handler in FUNCTIONS.items():
        spark.udtf.register(name, arrow_udtf(handler, returnType=handler.columns))
