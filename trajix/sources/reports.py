"""Sinks of results: delimited text and JSON, and conversion between files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajix.model import Topology, keys
from trajix.sources import structures, trajectories


def write_delimited(rows: DataFrame, path: str, separator: str = ",", digits: int = 6) -> None:
    """CSV or TSV with a header; doubles with fixed digits, nulls as empty cells."""
    shown = [F.format_string(f"%.{digits}f", c).alias(c) if t in ("double", "float") else F.col(c) for c, t in rows.dtypes]
    blank = [F.when(F.col(c).isNotNull(), s).alias(c) for (c, _), s in zip(rows.dtypes, shown)]
    rows.select(*blank).write.mode("overwrite").option("header", True).option("sep", separator).csv(path)


def frame_records(rows: DataFrame, name: str) -> DataFrame:
    """frame and one JSON text with an array of its records, such as hydrogen bonds or contacts."""
    k = keys(rows)
    others = [c for c in rows.columns if c not in k]
    each = rows.groupBy(*k).agg(F.sort_array(F.collect_list(F.struct(*others))).alias(name))
    return each.select(*k, F.to_json(F.struct(*k, name)).alias("json"))


def write_json(rows: DataFrame, path: str) -> None:
    """A JSON object a row, nulls kept."""
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_topology(spark: SparkSession, path: str) -> Topology:
    return structures.read_structure(spark, path).topology(spark)


def convert(spark: SparkSession, source: str, target: str, topology: Topology | None = None) -> None:
    """Structure to structure, trajectory to trajectory, or a trajectory's first frame to a structure."""
    to = structures.extension(target)
    if structures.extension(source) in structures.READERS:
        s = structures.read_structure(spark, source)
        if to in structures.WRITERS:
            structures.write_structure(spark, s, target)
        else:
            trajectories.write_trajectory(s.frame(spark), target, to)
        return
    frames = trajectories.read_trajectory(spark, source)
    if to in structures.WRITERS:
        if topology is None:
            raise structures.StructureError("a structure needs a topology")
        structures.write_structure(spark, structures.structure_of(topology, frames.where("frame = 0").first()), target)
    else:
        trajectories.write_trajectory(frames, target, to)
