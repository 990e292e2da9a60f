"""Where frames lie: stripes of files, found by executors and kept, so that a read takes only what it needs.

A stripe is a run of whole frames of one file, with its bytes, the number of its frames and the range of
their times. Writers know the stripes of what they write and list them in the folder's manifest, one
file for each commit. The stripes of other files are found in parallel: each task takes a range of bytes,
looks for the first frame header in it and follows the headers from there. What tasks found is then
compared: where a range doesn't begin at the end of the frame before it, it is read again from there.
"""

from __future__ import annotations

import fnmatch
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import InputPartition

from trajix.sources.frame_codecs import FIXED, FORMATS, TrajectoryError, codec_of, opened, system_of

#: Bytes of a stripe, about.
STRIPE_BYTES = 32 << 20
MANIFEST = "_manifest"
STORED = pa.schema([("traj", pa.string()), ("file", pa.string()), *[(c, pa.int64()) for c in ("begin", "end", "number", "n")], *[(c, pa.float64()) for c in ("t_min", "t_max", "t_first", "t_last")]])


@dataclass
class Stripe(InputPartition):
    """Frames of ``traj`` from number ``first`` on: ``n`` frames of ``file`` in the bytes [begin, end), the first of which
    is the file's frame ``number``."""

    traj: str
    file: str
    begin: int
    end: int
    number: int
    n: int
    t_min: float = -math.inf
    t_max: float = math.inf
    t_first: float = math.nan
    t_last: float = math.nan
    first: int = 0

    def add(self, end: int, time: float) -> None:
        """A further frame up to byte ``end``."""
        if self.n == 0:
            self.t_first, self.t_min, self.t_max = time, math.inf, -math.inf
        known = not math.isnan(time)
        self.end, self.n, self.t_last = end, self.n + 1, time
        self.t_min, self.t_max = (min(self.t_min, time), max(self.t_max, time)) if known else (-math.inf, math.inf)


def files_of(path: str) -> list[tuple[str, list[str]]]:
    """Trajectories of a path that has no manifest, and the files of each, in order.

    A file is a trajectory. A folder is one too: its files follow each other by name. A pattern with *
    or ? in its last part stands for as many trajectories as it finds.
    """
    system, inner, before = system_of(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.Directory:
        found = system.get_file_info(fs.FileSelector(inner))
        names = sorted(f.path for f in found if f.type == fs.FileType.File and f.extension.lower() in FORMATS and not f.base_name.startswith((".", "_")))
        return [(path, [before + name for name in names])]
    if info.type == fs.FileType.NotFound:
        raise TrajectoryError(f"no such file: {path}")
    return [(path, [path])]


def matches(path: str) -> list[str]:
    """The path, or those that its pattern finds."""
    system, inner, before = system_of(path)
    folder, _, last = inner.rstrip("/").rpartition("/")
    if not any(c in last for c in "*?"):
        return [path]
    found = system.get_file_info(fs.FileSelector(folder or "."))
    return sorted(before + f.path for f in found if fnmatch.fnmatchcase(f.base_name, last) and not f.base_name.startswith((".", "_")))


def numbered(stripes: list[Stripe]) -> list[Stripe]:
    """Frame numbers that run on over the stripes of each trajectory."""
    so_far: dict[str, int] = {}
    out = []
    for s in stripes:
        out.append(replace(s, first=so_far.get(s.traj, 0)))
        so_far[s.traj] = so_far.get(s.traj, 0) + s.n
    return out


def save(stripes: list[Stripe], path: str, more: dict[str, str] | None = None) -> None:
    table = pa.table({c: [getattr(s, c) for s in stripes] for c in STORED.names}, schema=STORED).replace_schema_metadata(more or {})
    system, inner, _ = system_of(path)
    system.create_dir(inner.rpartition("/")[0], recursive=True)
    hidden = f"{inner.rpartition('/')[0]}/.{uuid.uuid4().hex}"
    with system.open_output_stream(hidden) as out:
        pq.write_table(table, out)
    system.move(hidden, inner)


def load(path: str) -> tuple[list[Stripe], dict]:
    system, inner, _ = system_of(path)
    with system.open_input_file(inner) as f:
        table = pq.read_table(f)
    return [Stripe(**r) for r in table.to_pylist()], table.schema.metadata or {}


def generations(folder: str) -> list[str]:
    """The manifests of a folder, oldest first; none where it has no manifest."""
    system, inner, before = system_of(folder)
    at = f"{inner.rstrip('/')}/{MANIFEST}"
    if system.get_file_info(at).type != fs.FileType.Directory:
        return []
    found = system.get_file_info(fs.FileSelector(at))
    return sorted(before + f.path for f in found if not f.base_name.startswith("."))


def listed(folder: str) -> list[Stripe] | None:
    """The stripes that a folder's manifests list, in the order of their commits; None where it has none."""
    names = generations(folder)
    if not names:
        return None
    out: list[Stripe] = []
    for name in names:
        stripes, more = load(name)
        out = [] if more.get(b"replace") else out
        out += [replace(s, file=f"{folder.rstrip('/')}/{s.file}") for s in stripes]
    return out


def _stripe(path: str, traj: str, begin: int, end: int, exact: bool) -> Stripe | None:
    """The frames that begin in the bytes [begin, end) of a file; exact: one does at ``begin``."""
    codec = codec_of(path)
    with opened(path, 1 << 12) as f:
        at = begin if exact else codec.find(f, begin, end)
        if at is None:
            return None
        number = codec.number(f, at) if codec in FIXED else 0
        out = Stripe(traj, path, at, at, number, 0)
        try:
            for head in codec.scan(f, at, end, number):
                out.add(head.end, head.time)
        except TrajectoryError:
            if exact:
                raise
            return None  # what looked like a frame was none
    return out


_FOUND = "k bigint, begin bigint, end bigint, number bigint, n bigint, t_min double, t_max double, t_first double, t_last double"


def _scanned(ranges: DataFrame) -> dict[int, Stripe]:
    """Stripes by k from ranges (k, path, traj, begin, end, exact), each found by a task."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(r["k"], _stripe(r["path"], r["traj"], r["begin"], r["end"], r["exact"])) for r in batch.to_pylist()]
            names = [c.split()[0] for c in _FOUND.split(", ")]
            made = [[k, *(getattr(s, c) for c in names[1:])] for k, s in found if s is not None]
            columns = zip(*made) if made else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i < 5 else pa.float64()) for i, c in enumerate(columns)], names=names)

    return {r["k"]: r for r in ranges.mapInArrow(rows, _FOUND).collect()}


def find_stripes(spark: SparkSession, files: list[tuple[str, str]], stripe_bytes: int = STRIPE_BYTES) -> list[Stripe]:
    """Stripes of files (traj, path), in their order; executors read the headers, the driver the files' sizes."""
    sized, k = [], 0
    for traj, path in files:
        system, inner, _ = system_of(path)
        size = system.get_file_info(inner).size
        parts = max(1, -(-size // stripe_bytes))
        sized.append((k, path, traj, size, parts))
        k += parts
    own = F.posexplode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("i", "part")
    table = spark.createDataFrame(sized, "first bigint, path string, traj string, size bigint, parts int").select("first", "path", "traj", "size", own)
    begin = F.col("part") * F.lit(stripe_bytes).cast("bigint")
    ranges = table.select((F.col("first") + F.col("part")).alias("k"), "path", "traj", begin.alias("begin"), F.least(begin + stripe_bytes, "size").alias("end"), (F.col("part") == 0).alias("exact"))
    found = _scanned(ranges.repartition(min(k, 10_000), "k"))
    passes = 0
    while True:  # each pass goes on where ranges disagree; the fourth reads a file to its end
        wrong = []
        for first, path, traj, size, parts in sized:
            at = 0
            for p in range(first, first + parts):
                end = size if passes > 3 else min((p - first + 1) * stripe_bytes, size)
                s = found.get(p)
                if at >= min((p - first + 1) * stripe_bytes, size):
                    found.pop(p, None)
                elif (s is None or s["begin"] != at) and codec_of(path) not in FIXED:
                    wrong.append((p, path, traj, at, end, True))
                    break
                elif s is not None and s["n"]:
                    at = s["end"]
                elif s is not None:  # a frame cut short: nothing follows
                    at = size
        if not wrong:
            break
        found |= _scanned(spark.createDataFrame(wrong, "k bigint, path string, traj string, begin bigint, end bigint, exact boolean").repartition(min(len(wrong), 10_000), "k"))
        passes += 1
    out = []
    for first, path, traj, _, parts in sized:
        out += [Stripe(traj, path, *[found[p][c] for c in ("begin", "end", "number", "n", "t_min", "t_max", "t_first", "t_last")]) for p in range(first, first + parts) if p in found and found[p]["n"]]
    return out


def stripes_here(path: str) -> list[Stripe]:
    """The stripes of a path, from its manifests, or else found by this process alone, reading all frame headers."""
    out = []
    for own in matches(path):
        known = listed(own)
        if known is None:
            known = []
            for traj, files in files_of(own):
                for name in files:
                    s = _stripe(name, traj, 0, 1 << 62, True)
                    known += cut(s) if s is not None and s.n else []
        out += known
    return numbered(out)


def cut(s: Stripe) -> list[Stripe]:
    """A stripe, in parts of about STRIPE_BYTES where its frames have one size."""
    if codec_of(s.file) not in FIXED or s.end - s.begin <= STRIPE_BYTES:
        return [s]
    stride = (s.end - s.begin) // s.n
    each = max(1, STRIPE_BYTES // stride)
    return [replace(s, begin=s.begin + k * stride, end=s.begin + min(s.n, k + each) * stride, number=s.number + k, n=min(each, s.n - k)) for k in range(0, s.n, each)]
