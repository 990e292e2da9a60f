"""Trajectories that grow, and values kept up to date over them."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSourceStreamReader
from pyspark.sql.streaming.state import GroupStateTimeout

from trajix.model import FRAMES
from trajix.sources import frame_index
from trajix.sources.frame_codecs import codec_of, opened
from trajix.sources.frame_index import Stripe
from trajix.sources.trajectories import _Reader

#: What a file header that is not whole yet gives.
EMPTY = (struct.error, IndexError)


class GrowingTrajectories(DataSourceStreamReader):
    """Frames of files as they gain them: of one file, or of all files of a folder or pattern, each its own trajectory.

    An offset has the whole frames of each file and the byte behind them. A trigger looks for new files and
    reads the headers of new frames alone; only the first one after a start reads them all. A frame that is
    not whole yet waits for a later trigger.
    """

    def __init__(self, options: dict, names: list[str] | None = None):
        self.path, self.options = options["path"], dict(options)
        self.names = names or [c.split()[0] for c in FRAMES.split(", ")]
        self.known: dict = self.initialOffset()

    def initialOffset(self) -> dict:
        return {"files": {}}

    def latestOffset(self) -> dict:
        files = dict(self.known["files"])
        for path in sorted(name for own in frame_index.matches(self.path) for _, names in frame_index.files_of(own) for name in names):
            frames, at = files.get(path, (0, 0))
            try:
                with opened(path) as f:
                    for head in codec_of(path).scan(f, at, f.size(), frames):
                        frames, at = frames + 1, head.end
            except EMPTY:  # a file that has only begun
                continue
            if frames:
                files[path] = [frames, at]
        self.known = {"files": files}
        return self.known

    def partitions(self, start: dict, end: dict) -> list[Stripe]:
        out = []
        for path, (frames, at) in end["files"].items():
            done, behind = start["files"].get(path, (0, 0))
            if frames > done:
                out += frame_index.cut(Stripe(path, path, behind, at, done, frames - done, first=done))
        return out

    def commit(self, end: dict) -> None:
        pass

    def read(self, part: Stripe) -> Iterator[pa.RecordBatch]:
        return _Reader(self.options, self.names).read(part)


def running_moments(points: DataFrame) -> DataFrame:
    """atom, n, mean, fluctuation of a stream of (atom, value): a row whenever an atom's values change.

    State is a count, a mean and a sum of squares for each atom; batches join it by the parallel
    update, so neither order nor batch size matters.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, mean, square = state.get if state.exists else (0, 0.0, 0.0)
        for batch in batches:
            v = batch["value"].dropna()
            if len(v):
                delta, both = v.mean() - mean, n + len(v)
                square += ((v - v.mean()) ** 2).sum() + delta * delta * n * len(v) / both
                mean += delta * len(v) / both
                n = both
        state.update((int(n), float(mean), float(square)))
        yield pd.DataFrame({"atom": [key[0]], "n": [n], "mean": [mean], "fluctuation": [(square / n) ** 0.5 if n else 0.0]})

    return points.groupBy("atom").applyInPandasWithState(
        update, "atom bigint, n bigint, mean double, fluctuation double", "n bigint, mean double, square double", "update", GroupStateTimeout.NoTimeout
    )


def windowed_means(points: DataFrame, watermark: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """window start, atom, n, mean of a stream of (ts, atom, value); later rows than the watermark are left out."""
    kept = points.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)  # watermarks need a time zone
    out = kept.groupBy(F.window("ts", window), "atom").agg(F.count("value").alias("n"), F.avg("value").alias("mean"))
    return out.select(F.col("window.start").alias("start"), "atom", "n", "mean")
