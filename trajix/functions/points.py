"""Points of many frames at once, in NumPy: runs of frames out of Arrow batches, and pairs of near points."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from trajix.model import keys

#: Points that one step works on; a larger frame makes a step of its own. Steps eight times as large are no faster, but a task holds all arrays of one.
STEP_POINTS = 1 << 16
#: Pairs that are looked at together.
STEP_PAIRS = 1 << 18


def runs(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray]]:
    """First and last row of runs of frames with as many atoms each, and their points as (frames, atoms, 3) doubles."""
    sizes = pc.list_value_length(batch["x"]).fill_null(0).to_numpy(zero_copy_only=False)
    at = 0
    while at < len(sizes):
        n = int(sizes[at])
        other = np.flatnonzero(sizes[at:] != n)
        end = min(at + int(other[0]) if len(other) else len(sizes), at + max(1, STEP_POINTS // max(1, n)))
        axes = [batch[c].slice(at, end - at).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(end - at, n) for c in "xyz"]
        yield at, end, np.stack(axes, axis=2)
        at = end


def per_frame(frames: DataFrame, columns: str, work: Callable[..., dict], extra: tuple[str, ...] = ()) -> DataFrame:
    """A frame's keys and ``columns``, which ``work`` makes of the points of some frames; no row moves.

    ``work`` gets (frames, atoms, 3) doubles and an Arrow array for each of the ``extra`` columns, and
    returns an array for each of its columns, in their order.
    """
    k, types = keys(frames), dict(frames.dtypes)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, points in runs(batch):
                made = work(points, *[batch[c].slice(at, end - at) for c in extra])
                own = [v if isinstance(v, pa.Array) else pa.array(v) for v in made.values()]
                yield pa.RecordBatch.from_arrays([*[batch[c].slice(at, end - at) for c in k], *own], names=[*k, *made])

    return frames.select(*k, *"xyz", *extra).mapInArrow(rows, ", ".join([*[f"{c} {types[c]}" for c in k], columns]))


def rows_of_frames(frames: DataFrame, columns: str, work: Callable[..., Iterator[tuple[np.ndarray, dict]]], extra: tuple[str, ...] = ()) -> DataFrame:
    """A frame's keys and ``columns``, any number of rows for each frame; no row moves.

    ``work`` gets what ``per_frame``'s does and yields, for some rows at a time, the frame of each among the
    given ones and an array for each column.
    """
    k, types = keys(frames), dict(frames.dtypes)
    kinds = pa.schema([(c.split()[0], {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "string": pa.string()}[c.split()[1]]) for c in columns.split(", ")])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, points in runs(batch):
                for owner, made in work(points, *[batch[c].slice(at, end - at) for c in extra]):
                    own = [batch[c].slice(at, end - at).take(pa.array(owner)) for c in k]
                    values = [v if isinstance(v, pa.Array) else pa.array(v, c.type) for c, v in ((c, made[c.name]) for c in kinds)]
                    yield pa.RecordBatch.from_arrays([*own, *values], names=[*k, *kinds.names])

    return frames.select(*k, *"xyz", *extra).mapInArrow(rows, ", ".join([*[f"{c} {types[c]}" for c in k], columns]))


def lists(values: np.ndarray) -> pa.ListArray:
    """The rows of a matrix as lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32()), pa.array(values.ravel()))


def close_pairs(points: np.ndarray, group: np.ndarray, cutoff: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ordered pairs a != b of points of one group nearer than the cutoff, and their distances.

    Points are sorted by cubic cells of the cutoff's size; each looks into the 27 cells around its
    own. All pairs of a point come in one step, steps in the order of cells.
    """
    if not len(points):
        return
    cell = np.floor(points / cutoff).astype(np.int64)
    cell += 1 - cell.min(0)
    width = cell.max(0) + 2
    key = ((group * width[0] + cell[:, 0]) * width[1] + cell[:, 1]) * width[2] + cell[:, 2]
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    around = [(x * width[1] + y) * width[2] for x in (-1, 0, 1) for y in (-1, 0, 1)]  # three cells in a row each
    low = np.stack([np.searchsorted(ordered, ordered + o - 1, "left") for o in around], axis=1)
    count = np.stack([np.searchsorted(ordered, ordered + o + 1, "right") for o in around], axis=1) - low
    total = np.cumsum(count.sum(1))
    at = 0
    while at < len(order):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + STEP_PAIRS, "right")))
        n = count[at:end].ravel()
        begin = np.repeat(low[at:end].ravel() - (np.cumsum(n) - n), n)
        a = order[np.repeat(np.arange(at, end), count[at:end].sum(1))]
        b = order[begin + np.arange(len(begin))]
        d = np.sqrt(((points[a] - points[b]) ** 2).sum(1))
        near = (d < cutoff) & (a != b)
        a, b, d = a[near], b[near], d[near]
        del begin, near  # not held while a step's pairs are worked on
        yield a, b, d
        at = end


def pairs_between(p: np.ndarray, p_group: np.ndarray, q: np.ndarray, q_group: np.ndarray, cutoff: float, inclusive: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of a point of ``p`` and one of ``q`` of the same group nearer than the cutoff, or as near, and their distances.

    Points of ``q`` are sorted by cubic cells of the cutoff's size, larger ones where points lie very far apart;
    each point of ``p`` looks into the 27 cells around its own. Points that are not finite are near to none.
    """
    p_at, q_at = (np.flatnonzero(np.isfinite(x).all(1)) for x in (p, q))
    if not len(p_at) or not len(q_at):
        return
    p, q, p_group, q_group = p[p_at], q[q_at], p_group[p_at], q_group[q_at]
    low_corner = np.minimum(p.min(0), q.min(0))
    extent = (np.maximum(p.max(0), q.max(0)) - low_corner).max()
    size = max(cutoff, extent / (1 << 16), 1e-9)
    cells = [np.floor((x - low_corner) / size).astype(np.int64) + 1 for x in (p, q)]
    width = np.maximum(cells[0].max(0), cells[1].max(0)) + 2
    p_key, q_key = (((g * width[0] + c[:, 0]) * width[1] + c[:, 1]) * width[2] + c[:, 2] for g, c in zip((p_group, q_group), cells))
    p_order, q_order = np.argsort(p_key, kind="stable"), np.argsort(q_key, kind="stable")
    looks, ordered = p_key[p_order], q_key[q_order]
    around = [(x * width[1] + y) * width[2] for x in (-1, 0, 1) for y in (-1, 0, 1)]  # three cells in a row each
    low = np.stack([np.searchsorted(ordered, looks + o - 1, "left") for o in around], axis=1)
    count = np.stack([np.searchsorted(ordered, looks + o + 1, "right") for o in around], axis=1) - low
    total = np.cumsum(count.sum(1))
    at = 0
    while at < len(p_order):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + STEP_PAIRS, "right")))
        n = count[at:end].ravel()
        begin = np.repeat(low[at:end].ravel() - (np.cumsum(n) - n), n)
        a = p_order[np.repeat(np.arange(at, end), count[at:end].sum(1))]
        b = q_order[begin + np.arange(len(begin))]
        d = np.sqrt(((p[a] - q[b]) ** 2).sum(1))
        near = d <= cutoff if inclusive else d < cutoff
        yield p_at[a[near]], q_at[b[near]], d[near]
        at = end
