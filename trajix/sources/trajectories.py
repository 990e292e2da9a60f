"""Trajectory files as Spark data sources: XTC, TRR, DCD and AMBER NetCDF, read by stripes of frames and written by parts.

``spark.read.format("trajectory").load(path)`` gives wide frames. A partition is a stripe of a file (see
frame_index). Bounds on frame and time leave out stripes, and within a stripe the frames that they
exclude are passed over by their headers; columns that the schema doesn't name are not read either.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from trajix.model import FRAMES
from trajix.sources import frame_index
from trajix.sources.frame_codecs import BOX, FIXED, FORMATS, V, X, Dcd, Frame, NetCdf, TrajectoryError, Trr, Xtc, cell_vectors, codec_of, opened, pack_coordinates, system_of, unpack_coordinates  # noqa: F401
from trajix.sources.frame_codecs import F as FORCES
from trajix.sources.frame_index import Stripe
from trajix.sources.shared import shared_path

#: Columns of velocities and forces, which the option ``sections`` adds.
SECTIONS = {"velocities": ("vx", "vy", "vz"), "forces": ("fx", "fy", "fz")}
NUMBERS = {"traj": pa.string(), "frame": pa.int64(), "time": pa.float64(), "step": pa.int32(), BOX: pa.list_(pa.float64())}
ARRAYS = {**{c: (X, k) for k, c in enumerate("xyz")}, **{c: (V, k) for k, c in enumerate(SECTIONS["velocities"])}, **{c: (FORCES, k) for k, c in enumerate(SECTIONS["forces"])}}
#: Atoms in one Arrow batch of a reader, about.
BATCH_ATOMS = 1 << 18
#: Frames up to this size are read ahead, larger ones that are passed over are not.
SMALL_FRAME = 1 << 14
READ_AHEAD = 1 << 20


def bounds_of(text: str) -> tuple[float, float]:
    """An interval, both ends included, from "lo,hi"; an end may be left out."""
    lo, _, hi = text.partition(",")
    return float(lo or -math.inf), float(hi or math.inf)


class _Reader(ds.DataSourceReader):
    """Stripes of an index that the option ``index`` names, of a folder's manifests, or found on planning.

    The options ``frames`` and ``times`` bound what is read. Spark 4.1 keeps what a Python reader was once
    told by pushFilters for later queries over the same DataFrame, which would then lack rows; so this
    reader takes bounds when it is made, and no pushed filters.
    """

    def __init__(self, options: dict, names: list[str]):
        self.path, self.index, self.names = options["path"], options.get("index"), names
        self.frames, self.times = bounds_of(options.get("frames", "")), bounds_of(options.get("times", ""))
        self.want = frozenset({ARRAYS[c][0] for c in names if c in ARRAYS} | {BOX} & set(names))

    def partitions(self) -> list[Stripe]:
        known = frame_index.numbered(frame_index.load(self.index)[0]) if self.index else frame_index.stripes_here(self.path)
        (lo, hi), (early, late) = self.frames, self.times
        fits = lambda s: s.first <= hi and s.first + s.n > lo and s.t_min <= late and s.t_max >= early
        return [s for s in known if fits(s)] or [Stripe("", "", 0, 0, 0, 0)]

    def read(self, part: Stripe) -> Iterator[pa.RecordBatch]:
        if not part.n:
            return
        codec, (lo, hi), (early, late) = codec_of(part.file), self.frames, self.times
        begin, number, left = part.begin, part.number, part.n
        skip = math.ceil(lo) - part.first if lo > part.first else 0
        if codec in FIXED and skip:
            begin, number, left = begin + skip * ((part.end - part.begin) // part.n), number + skip, left - skip
        first = part.first + number - part.number
        rows: list[tuple[int, Frame]] = []
        atoms = 0
        all_of_it = X in self.want and lo <= part.first and hi >= part.first + part.n - 1 and early <= part.t_min and late >= part.t_max
        with opened(part.file, READ_AHEAD if all_of_it or part.end - part.begin < SMALL_FRAME * part.n else 128, part.end + (1 << 16 if codec in FIXED else 0)) as f:
            for k, head in enumerate(codec.scan(f, begin, part.end, number), first):
                if k > hi or k >= part.first + part.n:
                    break
                if k < lo or not early <= head.time <= late and self.times != (-math.inf, math.inf):
                    continue
                x = codec.read(f, head.at, number + k - first, self.want)
                rows.append((k, x))
                atoms += sum(len(a) for a in (x.xyz, x.v, x.f) if a is not None) + 1
                if atoms >= BATCH_ATOMS:
                    yield self.batch(part.traj, rows)
                    rows, atoms = [], 0
        if rows:
            yield self.batch(part.traj, rows)

    def batch(self, traj: str, rows: list[tuple[int, Frame]]) -> pa.RecordBatch:
        def column(name: str) -> pa.Array:
            if name in ARRAYS:
                section, axis = ARRAYS[name]
                own = [{X: x.xyz, V: x.v, FORCES: x.f}[section] for _, x in rows]
                return pa.array([None if a is None else np.ascontiguousarray(a[:, axis], float) for a in own], pa.list_(pa.float64()))
            values = {"traj": lambda k, x: traj, "frame": lambda k, x: k, "time": lambda k, x: float(x.time), "step": lambda k, x: int(x.step), BOX: lambda k, x: x.box}
            return pa.array([values[name](k, x) for k, x in rows], NUMBERS[name])

        return pa.RecordBatch.from_arrays([column(c) for c in self.names], names=self.names)


@dataclass
class _Part:
    """A file that a task wrote, with the frame numbers of its rows."""

    task: int
    name: str
    hidden: str
    traj: str
    first: int | None = None
    last: int | None = None
    stripes: list[Stripe] = field(default_factory=list)


@dataclass
class _Written(ds.WriterCommitMessage):
    parts: list[_Part]


class _Writer(ds.DataSourceArrowWriter):
    """Each task writes a file for each trajectory in its rows, frame by frame, under hidden names; the driver's commit
    names the files of the attempts that count and lists them in a new manifest. Frames must come in order."""

    def __init__(self, options: dict, schema, overwrite: bool):
        self.path, self.names, self.overwrite = options["path"].rstrip("/"), schema.fieldNames(), overwrite
        self.kind = (options.get("kind") or self.path.rsplit(".", 1)[-1]).lower()
        self.how = {"double": options.get("double", "false").lower() == "true", "precision": float(options.get("precision", 1000))}
        if self.kind not in FORMATS:
            raise TrajectoryError(f"no writer for {self.kind}")

    def write(self, batches) -> _Written:
        made: list[str] = []
        try:
            return self._write(batches, made)
        except BaseException:  # what a lost executor leaves is hidden, and listed nowhere
            system, _, _ = system_of(self.path)
            for name in made:
                if system.get_file_info(name).type == fs.FileType.File:
                    system.delete_file(name)
            raise

    def _write(self, batches, made: list[str]) -> _Written:
        from pyspark import TaskContext

        codec, task = FORMATS[self.kind], TaskContext.get().partitionId()
        system, inner, _ = system_of(self.path)
        done: list[_Part] = []
        out = part = None
        n = frames = at = 0

        def close() -> None:
            out.close()
            head = codec.head(n, frames)
            if head:  # it tells the number of frames, so it comes last, and is put before them
                body, part.hidden = part.hidden, f"{inner}/.whole-{part.name}"
                with system.open_output_stream(part.hidden) as f, system.open_input_stream(body) as g:
                    f.write(head)
                    while block := g.read(8 << 20):
                        f.write(block)
                system.delete_file(body)
            part.stripes = [s for s in part.stripes if s.n]
            done.append(part)

        for batch in batches:
            columns = {c: batch.column(i) for i, c in enumerate(self.names)}
            of = lambda c, k, default: default if c not in columns or (v := columns[c][k].as_py()) is None else v  # noqa: B023, E731

            def section(names, k) -> np.ndarray | None:
                own = [columns[c][k] for c in names if c in columns and columns[c][k].is_valid]  # noqa: B023
                return np.stack([a.values.to_numpy(zero_copy_only=False).astype(float) for a in own], axis=1) if len(own) == 3 else None

            for k in range(batch.num_rows):
                xyz, traj, number = section("xyz", k), of("traj", k, ""), of("frame", k, None)
                if xyz is None:
                    raise TrajectoryError("a frame without coordinates")
                if part is None or part.traj != traj:
                    if part is not None:
                        close()
                    name = f"part-{task:05d}-{len(done):03d}-{uuid.uuid4().hex[:12]}.{self.kind}"
                    system.create_dir(inner, recursive=True)
                    part, n, frames, at = _Part(task, name, f"{inner}/.{name}", traj, number), len(xyz), 0, 0
                    made += [part.hidden, f"{inner}/.whole-{name}"]
                    out = system.open_output_stream(part.hidden)
                if len(xyz) != n:
                    raise TrajectoryError("InvalidAtomCount")
                if number is not None and part.last is not None and number <= part.last:
                    raise TrajectoryError("frames out of order: sort by traj and frame first")
                part.last = number
                if not part.stripes or part.stripes[-1].end - part.stripes[-1].begin >= frame_index.STRIPE_BYTES:
                    part.stripes.append(Stripe(traj, part.name, at, at, frames, 0))
                time = of("time", k, 0.0)
                raw = codec.write(Frame(time, of("step", k, 0), of(BOX, k, None), xyz, section(SECTIONS["velocities"], k), section(SECTIONS["forces"], k)), **self.how)
                at += len(raw)
                part.stripes[-1].add(at, codec.kept_time(time, frames, **self.how))
                frames += 1
                out.write(raw)
        if part is not None:
            close()
        return _Written(done)

    def _in_order(self, messages) -> list[_Part]:
        """Parts by trajectory and frame; parts that overlap can't be put in an order."""
        parts = sorted((p for m in messages if m is not None for p in m.parts), key=lambda p: (p.traj, p.first if p.first is not None else -1, p.task, p.name))
        for a, b in zip(parts, parts[1:]):
            if a.traj == b.traj and a.last is not None and b.first is not None and b.first <= a.last:
                raise TrajectoryError(f"parts of {a.traj!r} overlap at frame {b.first}: repartition by range of traj and frame first")
        return parts

    def commit(self, messages) -> None:
        system, inner, before = system_of(self.path)
        known = frame_index.generations(self.path)
        parts = self._in_order(messages)
        here = system.get_file_info(inner).type
        if here == fs.FileType.File or here == fs.FileType.Directory and not known and any(files for _, files in frame_index.files_of(self.path)):
            raise TrajectoryError(f"{self.path} holds frames that no manifest lists")
        for p in parts:
            system.move(p.hidden, f"{inner}/{p.name}")
        number = int(known[-1].rpartition("/")[2].split("-")[0]) + 1 if known else 0
        name = f"{self.path}/{frame_index.MANIFEST}/{number:08d}-{uuid.uuid4().hex[:12]}.parquet"
        old = frame_index.listed(self.path) or [] if self.overwrite else []
        frame_index.save([s for p in parts for s in p.stripes], name, {"replace": "true"} if self.overwrite else None)
        for path in {s.file for s in old}:
            system.delete_file(system_of(path)[1])

    def abort(self, messages) -> None:
        system, _, _ = system_of(self.path)
        for p in (p for m in messages if m is not None for p in m.parts):
            if system.get_file_info(p.hidden).type == fs.FileType.File:
                system.delete_file(p.hidden)


class TrajectorySource(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "trajectory"

    def schema(self) -> str:
        """FRAMES, and the columns of the sections that the option names."""
        asked = [s.strip() for s in self.options.get("sections", "").split(",") if s.strip()]
        return ", ".join([FRAMES, *[f"{c} array<double>" for s in asked for c in SECTIONS[s]]])

    def reader(self, schema) -> _Reader:
        return _Reader(self.options, schema.fieldNames())

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options, schema, overwrite)

    def streamReader(self, schema):
        from trajix.streaming.frames import GrowingTrajectories

        return GrowingTrajectories(self.options, schema.fieldNames())


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(TrajectorySource)


def index_trajectories(spark: SparkSession, path: str, to: str | None = None, stripe_bytes: int = frame_index.STRIPE_BYTES) -> str:
    """Find the stripes of a path's files on the executors and keep them in a file, whose path is returned.

    Files of folders that this library wrote are listed there already, and are not read.
    """
    stripes: list[Stripe] = []
    for own in frame_index.matches(path):
        known = frame_index.listed(own)
        stripes += known if known is not None else frame_index.find_stripes(spark, [(traj, name) for traj, files in frame_index.files_of(own) for name in files], stripe_bytes)
    to = to or shared_path(spark, "-frames.parquet")
    frame_index.save(stripes, to)
    return to


def read_trajectory(
    spark: SparkSession, path: str, columns: list[str] | None = None, sections: tuple[str, ...] = (), frames: tuple | None = None, times: tuple | None = None, index: str | None = None
) -> DataFrame:
    """Wide frames of a trajectory's file or folder, or of each that a pattern finds.

    ``traj`` is what was written, or else the path. ``columns`` are those to read: without x, y and z no
    coordinate is. ``sections`` adds velocities (vx, vy, vz, Å/ps) and forces (fx, fy, fz, kJ/mol/Å) of
    TRR files, null where a frame has none. ``frames`` and ``times`` are (first, last), either of which may be
    None: other stripes are not opened, and other frames passed over by their headers. An index from ``index_trajectories`` saves finding frames anew.
    """
    register(spark)
    ends = lambda pair: ",".join("" if v is None else repr(v) for v in pair or (None, None))
    reader = spark.read.format("trajectory").option("index", index or index_trajectories(spark, path)).option("sections", ",".join(sections))
    reader = reader.option("frames", ends(frames)).option("times", ends(times))
    if columns is not None:
        whole = _parse_datatype_string(TrajectorySource({"sections": ",".join(sections)}).schema())
        reader = reader.schema(type(whole)([whole[c] for c in columns]))
    return reader.load(path)


def trajectory_times(spark: SparkSession, path: str) -> DataFrame:
    """traj, n_frames, first_time and last_time of each trajectory, from headers alone."""
    heads = read_trajectory(spark, path, ["traj", "frame", "time"])
    return heads.groupBy("traj").agg(F.count("*").alias("n_frames"), F.min_by("time", "frame").alias("first_time"), F.max_by("time", "frame").alias("last_time"))


def write_trajectory(frames: DataFrame, path: str, kind: str, mode: str = "append", double: bool = False, precision: float = 1000.0) -> None:
    """Write frames as files of the kind in the folder ``path``, one per task and trajectory, and list them in its manifest.

    Rows of a task must be in order of traj and frame, and tasks' ranges must not overlap: use
    repartitionByRange and sortWithinPartitions. A further write with mode "append" adds its frames behind those
    that are there, and "overwrite" replaces them. TRR keeps vx, vy, vz and fx, fy, fz, in eight bytes if
    ``double``; XTC rounds to 1 / ``precision`` nm.
    """
    register(frames.sparkSession)
    frames.write.format("trajectory").option("kind", kind).option("double", double).option("precision", precision).mode(mode).save(path)
