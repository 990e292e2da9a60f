"""Values over the frames of a trajectory: fluctuations, displacements, covariance, principal components."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trajix.functions.points import lists, per_frame, runs
from trajix.model import keys, to_long
from trajix.sources.shared import shared_path

#: Dimensions of a covariance matrix at most, and of one that the driver solves.
MOST_DIMENSIONS, MOST_SOLVED = 30_000, 3_000
#: Dimensions of a tile's side, and bytes of tiles that a task holds.
TILE, MOST_TILE_BYTES = 256, 256 << 20
#: Arrays that a group adds up.
FAN = 64
#: Columns of the basis that the driver keeps: 58 MB each for it and its image at MOST_DIMENSIONS.
MOST_BASIS = 240
PARTS = "key bigint, task bigint, v array<double>"
PAIRS_A_TASK = 8


def _track(frames: DataFrame) -> list[str]:
    """The column that tells trajectories apart, where frames have one."""
    return [c for c in ("traj",) if c in frames.columns]


def rmsf(frames: DataFrame, atoms: list[int] | None = None) -> DataFrame:
    """atom_index (of each traj, if frames name one), value: root mean square distance from the mean position, as frames are."""
    if frames.isEmpty():
        raise ValueError("NoFrames")
    spread = sum((F.var_pop(c) for c in "yz"), F.var_pop("x"))
    return to_long(frames, atoms).groupBy(*_track(frames), "atom_index").agg(F.sqrt(spread).alias("value"))


def _in_order(frames: DataFrame, block: int) -> DataFrame:
    """Frames with their place in their trajectory's order and the last block's number.

    Trajectories of one block are numbered in a window each. Longer ones are sorted by ranges and written;
    a row's place is then its number in the range, behind the rows of the ranges before.
    """
    t = _track(frames)
    rows = frames.select(*[F.coalesce(F.concat(F.lit("t"), c), F.lit("")).alias(c) for c in t], "frame", *"xyz")
    longest = rows.groupBy(*t).count().agg(F.max("count")).first()[0] or 0
    if longest <= block:
        return rows.select(*t, F.lit(0).alias("last"), (F.row_number().over(Window.partitionBy(*t).orderBy("frame")) - 1).cast("bigint").alias("frame"), *"xyz")
    path = shared_path(frames.sparkSession, "-frames")
    ranged = rows.repartitionByRange(*t, "frame").sortWithinPartitions(*t, "frame")
    ranged.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row")).write.parquet(path)
    rows = frames.sparkSession.read.parquet(path)
    whole = Window.partitionBy(*t)
    sizes = rows.groupBy(*t, "part").agg(F.count("*").alias("n"), F.min("row").alias("low"))
    sizes = sizes.select(*t, "part", "low", (F.sum("n").over(whole.orderBy("part")) - F.col("n")).alias("before"), F.floor((F.sum("n").over(whole) - 1) / block).cast("int").alias("last"))
    return rows.join(sizes, [*t, "part"]).select(*t, "last", (F.col("before") + F.col("row") - F.col("low")).alias("frame"), *"xyz")


def msd(frames: DataFrame, atoms: list[int] | None = None, block: int = 8192) -> DataFrame:
    """lag (of each traj, if frames name one), value: mean square displacement over all atoms and all starts, by the order of frames.

    Tracks are cut into blocks of ``block`` frames. A task correlates up to PAIRS_A_TASK pairs of an
    atom's blocks that lie equally far apart, by Fourier transforms, so that its memory does not grow
    with the frames; the pairs grow with the square of a track's blocks. Coordinates are not unwrapped.
    """
    t = _track(frames)
    size = 1 << (2 * block - 1).bit_length()

    def correlate(table: pa.Table) -> pa.Table:
        apart, sides = table["apart"][0].as_py(), ({}, {})
        for k in range(table.num_rows):
            row = dict(zip("txyz", table["r"][k].values.flatten()))
            sides[table["side"][k].as_py()][table["i"][k].as_py()] = np.stack([row[c].to_numpy(zero_copy_only=False) for c in "xyz"], axis=1)
        middle = np.mean([r.mean(0) for side in sides for r in side.values()], axis=0)
        total, n = np.zeros(2 * block - 1), np.zeros(2 * block - 1, np.int64)
        for i in sides[0].keys() & sides[1].keys():
            p, q = sides[0][i] - middle, sides[1][i] - middle
            m = np.arange(1 - len(p), len(q))  # the place in q less the place in p
            begin, end = np.maximum(0, -m), np.minimum(len(p), len(q) - m)
            together = np.fft.irfft(np.fft.rfft(p, size, axis=0).conj() * np.fft.rfft(q, size, axis=0), size, axis=0).sum(1)[m]
            own, other = (np.concatenate([[0.0], np.cumsum((v * v).sum(1))]) for v in (p, q))
            sums = own[end] - own[begin] + other[end + m] - other[begin + m] - 2 * together
            total[m + block - 1] += np.maximum(sums, 0)
            n[m + block - 1] += end - begin
        lag = np.arange(1 - block, block) + apart * block
        total[lag == 0] = 0.0
        kept = (lag >= 0) & (n > 0)
        found = pa.table({"lag": lag[kept], "total": total[kept], "n": n[kept]})
        for c in t:
            found = found.append_column(c, pa.array([table[c][0].as_py()] * found.num_rows, pa.string()))
        return found

    long = to_long(_in_order(frames, block), atoms, ("last",))
    blocks = long.groupBy(*t, "last", "atom_index", F.floor(F.col("frame") / block).cast("int").alias("b")).agg(F.sort_array(F.collect_list(F.struct("frame", *"xyz"))).alias("r"))
    first = F.transform(F.sequence(F.lit(0), F.col("last") - F.col("b")), lambda d: F.struct(d.alias("apart"), F.col("b").alias("i"), F.lit(0).alias("side")))
    second = F.transform(F.sequence(F.lit(0), F.col("b")), lambda d: F.struct(d.alias("apart"), (F.col("b") - d).alias("i"), F.lit(1).alias("side")))
    pairs = blocks.select(*t, "atom_index", "r", F.explode(F.concat(first, second)).alias("p")).select(*t, "atom_index", "r", "p.*").withColumn("some", F.floor(F.col("i") / PAIRS_A_TASK))
    parts = pairs.groupBy(*t, "atom_index", "apart", "some").applyInArrow(correlate, ", ".join(["lag bigint, total double, n bigint", *[f"{c} string" for c in t]]))
    named = [F.when(F.col(c) != "", F.substring(c, 2, 1 << 30)).alias(c) for c in t]
    return parts.groupBy(*t, "lag").agg((F.sum("total") / F.sum("n")).alias("value")).select(*named, "lag", "value")


@dataclass(frozen=True)
class _Center:
    """What a first pass over the frames finds: how many they are, the mean and the variance of each dimension, and the tasks."""

    own: np.ndarray
    n: int
    mean: np.ndarray
    variance: np.ndarray
    tasks: int

    def about(self, points: np.ndarray) -> np.ndarray:
        """A row for each frame: its chosen coordinates less the mean."""
        return points[:, self.own].reshape(len(points), -1) - self.mean


def _summed(parts: DataFrame, tasks: int) -> DataFrame:
    """key and v, the sums of the arrays v of each key, from rows (key, task, v) of so many tasks.

    Arrays are added up in levels, at most FAN of a key in a group.
    """

    def added(table: pa.Table) -> pa.Table:
        total = np.zeros(len(table["v"][0]))
        for v in table["v"]:
            total += v.values.to_numpy(zero_copy_only=False)
        return pa.table({"key": table["key"][:1], "task": table["task"][:1], "v": pa.array([total], pa.list_(pa.float64()))})

    while True:
        tasks = -(-tasks // FAN)
        group = F.lit(0) if tasks <= 1 else F.floor(F.col("task") / FAN)
        parts = parts.withColumn("task", group.cast("bigint")).groupBy("key", "task").applyInArrow(added, PARTS)
        if tasks <= 1:
            return parts.drop("task")


def _emitted(arrays: Iterator[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get().partitionId()
    for key, v in arrays:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([task], pa.int64()), pa.array([v.ravel()], pa.list_(pa.float64()))], names=["key", "task", "v"])


def _collected(summed: DataFrame) -> np.ndarray:
    return np.concatenate([np.array(r["v"]) for r in sorted(summed.collect(), key=lambda r: r["key"])])


def _center(frames: DataFrame, atoms: list[int] | None) -> _Center:
    first = frames.orderBy("frame").limit(1).select(*"xyz").first()
    if first is None:
        raise ValueError("TooFewFrames")
    own = np.arange(len(first["x"])) if atoms is None else np.array(atoms, int)
    if 3 * len(own) > MOST_DIMENSIONS:
        raise ValueError("DimensionTooLarge")
    origin = np.array([first[c] for c in "xyz"], float).T[own].ravel()
    dim = len(origin)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, square = 0, np.zeros(dim), np.zeros(dim)
        for batch in batches:
            for _, _, points in runs(batch):
                r = points[:, own].reshape(len(points), -1) - origin
                n, total, square = n + len(r), total + r.sum(0), square + (r * r).sum(0)
        # n stands for a task with frames and 1 for any task, in an array of their own
        yield from _emitted([(0, np.array([float(n), TaskContext.get().partitionId() + 1.0])), *((1 + k, np.stack([total, square])[:, a : a + TILE]) for k, a in enumerate(range(0, dim, TILE)))])

    parts = frames.select(*"xyz").mapInArrow(sums, PARTS)
    # tasks are not known yet; dimensions are few, so plain sums of their numbers do
    own_rows = parts.select("key", F.posexplode("v").alias("d", "v")).groupBy("key", "d").agg(F.sum("v").alias("v"), F.max("v").alias("most")).collect()
    found = {(r["key"], r["d"]): r for r in own_rows}
    n = int(found[0, 0]["v"])
    if n < 2:
        raise ValueError("TooFewFrames")
    widths = [min(TILE, dim - a) for a in range(0, dim, TILE)]
    sums_, squares = (np.array([found[1 + k, side * w + d]["v"] for k, w in enumerate(widths) for d in range(w)]) for side in (0, 1))
    return _Center(own, n, origin + sums_ / n, np.maximum(0, squares - sums_**2 / n) / (n - 1), int(found[0, 1]["most"]))


def covariance(frames: DataFrame, atoms: list[int] | None = None, most_bytes: int = MOST_TILE_BYTES) -> DataFrame:
    """i, j, value for i <= j: sample covariance of the coordinates x0, y0, z0, x1, ..., over the frames of all trajectories together.

    A first pass finds the means. In the second, a task adds up its frames' products about them, in square
    tiles of TILE dimensions: all tiles where these take ``most_bytes``, or else a share of them, each share
    in a scan of its own. Tiles then add up in levels, so that neither a task nor a group grows with the
    frames or the tasks.
    """
    center = _center(frames, atoms)
    dim, n = len(center.mean), center.n
    starts = list(range(0, dim, TILE))
    pairs = [(a, b) for a in starts for b in starts if a <= b]
    each = max(1, most_bytes // (8 * TILE * TILE))

    def products(share: list[tuple[int, int]]):
        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tiles: dict[tuple[int, int], np.ndarray] = {}
            for batch in batches:
                for _, _, points in runs(batch):
                    r = center.about(points)
                    for a, b in share:
                        own = r[:, a : a + TILE].T @ r[:, b : b + TILE]
                        if (a, b) in tiles:
                            tiles[a, b] += own
                        else:
                            tiles[a, b] = own
            yield from _emitted((a * MOST_DIMENSIONS + b, v) for (a, b), v in tiles.items())

        return frames.select(*"xyz").mapInArrow(rows, PARTS)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, v in zip(batch["key"].to_pylist(), batch["v"]):
                a, b = divmod(key, MOST_DIMENSIONS)
                tile = v.values.to_numpy().reshape(min(TILE, dim - a), min(TILE, dim - b)) / (n - 1)
                i, j = np.nonzero(np.add.outer(np.arange(len(tile)) + a, -np.arange(tile.shape[1]) - b) <= 0)
                yield pa.RecordBatch.from_arrays([pa.array((i + a).astype(np.int32)), pa.array((j + b).astype(np.int32)), pa.array(tile[i, j])], names=["i", "j", "value"])

    shares = [products(pairs[k : k + each]) for k in range(0, len(pairs), each)]
    summed = [_summed(share, center.tasks).mapInArrow(cells, "i int, j int, value double") for share in shares]
    return reduce(DataFrame.unionAll, summed)


def _leading(frames: DataFrame, center: _Center, k: int, extra: int, tolerance: float, most_passes: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of the covariance, and their vectors as columns, by iteration on a random block.

    Each pass over the frames multiplies the covariance with a thin block: tasks add up r (r . block), and
    these sums add up in levels. The driver keeps an orthonormal basis of all blocks so far, of at most
    MOST_BASIS columns, solves the small problem in it, and stops when the residuals of the leading pairs
    are below ``tolerance`` times the largest eigenvalue. The covariance itself is never made.
    """
    dim, b = len(center.mean), min(len(center.mean), k + extra)

    def times(block: np.ndarray) -> np.ndarray:
        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                for _, _, points in runs(batch):
                    r = center.about(points)
                    own = r.T @ (r @ block)
                    total = own if total is None else total + own
            step = max(1, TILE * TILE // block.shape[1])
            yield from _emitted((at, total[at : at + step]) for at in range(0, dim if total is not None else 0, step))

        return _collected(_summed(frames.select(*"xyz").mapInArrow(rows, PARTS), center.tasks)).reshape(dim, -1) / (center.n - 1)

    rng = np.random.default_rng(seed)
    block = np.linalg.qr(rng.normal(size=(dim, b)))[0]
    basis, image = np.zeros((dim, 0)), np.zeros((dim, 0))
    for _ in range(most_passes):
        made = times(block)
        basis, image = np.hstack([basis, block]), np.hstack([image, made])
        small = basis.T @ image
        values, s = np.linalg.eigh((small + small.T) / 2)
        values, s = values[::-1], s[:, ::-1]
        lead = s[:, :k]
        residual = np.linalg.norm(image @ lead - basis @ lead * values[:k], axis=0).max(initial=0.0)
        rest = made - basis @ (basis.T @ made)
        rest -= basis @ (basis.T @ rest)
        block, scale = np.linalg.qr(rest)
        block = block[:, np.abs(np.diag(scale)) > 1e-13 * max(values[0], 1e-300)][:, : dim - basis.shape[1]]
        if residual <= tolerance * max(values[0], 0.0) or not block.shape[1]:
            return values[:k], basis @ lead
        if basis.shape[1] + block.shape[1] > MOST_BASIS:
            keep = s[:, : max(k + extra, MOST_BASIS // 3)]
            basis, image = basis @ keep, image @ keep
    raise ValueError(f"NotConverged: after {most_passes} passes the residual is {residual:.3g} of {values[0]:.3g}")


def pca(
    frames: DataFrame, atoms: list[int] | None = None, n_components: int | None = None, extra: int = 10, tolerance: float = 1e-9, most_passes: int = 100, seed: int = 7
) -> tuple[DataFrame, DataFrame]:
    """(component, eigenvalue, variance_ratio) and (component, dim, loading), by falling eigenvalue.

    With ``n_components`` the leading ones come from passes over the frames, at up to MOST_DIMENSIONS;
    shares are of the whole variance. Without it, all come from the covariance, which the driver solves at
    up to MOST_SOLVED dimensions. A component's largest loading is positive.
    """
    spark = frames.sparkSession
    if n_components is None:
        n_atoms = frames.select(F.size("x")).first()[0] if atoms is None else len(atoms)
        if 3 * n_atoms > MOST_SOLVED:
            raise ValueError("DimensionTooLarge: name n_components")
        found = covariance(frames, atoms).toPandas()
        dim = int(found["j"].max()) + 1
        c = np.zeros((dim, dim))
        c[found["i"], found["j"]] = c[found["j"], found["i"]] = found["value"]
        values, vectors = np.linalg.eigh(c)
        values, vectors = values[::-1], vectors[:, ::-1]
        whole = np.maximum(values, 0).sum()
    else:
        center = _center(frames, atoms)
        dim, whole = len(center.mean), center.variance.sum()
        values, vectors = _leading(frames, center, min(n_components, dim), extra, tolerance, most_passes, seed)
    k = len(values)
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(k)])
    ratio = np.maximum(values, 0) / max(whole, 1e-300)
    head = spark.createDataFrame([(i, float(values[i]), float(ratio[i])) for i in range(k)], "component int, eigenvalue double, variance_ratio double")
    component, d = np.divmod(np.arange(k * dim, dtype=np.int32), np.int32(dim))
    loads = spark.createDataFrame(pa.table({"component": component, "dim": d, "loading": np.ascontiguousarray(vectors.T).ravel()}))
    return head, loads


def projections(frames: DataFrame, loadings: DataFrame, atoms: list[int] | None = None) -> DataFrame:
    """frame, component, value: frames less the mean frame, along the components of ``pca`` with the same atoms."""
    rows = loadings.orderBy("component", "dim").collect()  # bounded as pca is
    axes = np.array([r["loading"] for r in rows]).reshape(len({r["component"] for r in rows}), -1)
    own = None if atoms is None else np.array(atoms, int)
    means = to_long(frames, atoms).groupBy("atom_index").agg(*[F.avg(c).alias(c) for c in "xyz"]).collect()
    at = {r["atom_index"]: (r["x"], r["y"], r["z"]) for r in means}
    mean = np.array([at[i] for i in (sorted(at) if own is None else own.tolist())]).ravel()

    def along(points: np.ndarray) -> dict:
        chosen = points if own is None else points[:, own]
        return {"v": lists((chosen.reshape(len(points), -1) - mean) @ axes.T)}

    found = per_frame(frames, "v array<double>", along)
    return found.select(*keys(frames), F.posexplode("v").alias("component", "value"))
