import numpy as np
from pyspark.sql import functions as F

from trajix.sources import trajectories
from trajix.streaming import frames as streaming


def test_running_moments_match_the_batch(spark, tables, tmp_path):
    points = spark.read.parquet(f"{tables}/events.parquet").select((F.col("user_id") % 5).cast("bigint").alias("atom"), "value")
    points.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(points.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streaming.running_moments(stream).writeStream.format("memory").queryName("moments").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    last = {r["atom"]: r for r in spark.sql("SELECT atom, max_by(struct(*), n) AS r FROM moments GROUP BY atom").select("r.*").collect()}
    for r in points.groupBy("atom").agg(F.count("value").alias("n"), F.avg("value").alias("m"), F.stddev_pop("value").alias("s")).collect():
        assert last[r["atom"]]["n"] == r["n"]
        assert np.allclose((last[r["atom"]]["mean"], last[r["atom"]]["fluctuation"]), (r["m"], r["s"]))


def _read(reader, start, end):
    return [r for p in reader.partitions(start, end) for b in reader.read(p) for r in b.to_pylist()]


def test_growing_trajectory(tmp_path):
    codec, path = trajectories.Trr, tmp_path / "x.trr"
    raw = [codec.write(trajectories.Frame(k, k, None, np.full((2, 3), float(k)))) for k in range(5)]
    path.write_bytes(b"".join(raw[:3]))
    reader = streaming.GrowingTrajectories({"path": str(path)})
    first = reader.latestOffset()
    assert first == {"files": {str(path): [3, sum(map(len, raw[:3]))]}}
    path.write_bytes(b"".join(raw) + raw[0][:50])  # the last frame is not whole yet
    then = reader.latestOffset()
    assert then["files"][str(path)][0] == 5 and reader.latestOffset() == then
    rows = _read(reader, first, then)
    assert [r["frame"] for r in rows] == [3, 4] and rows[1]["x"] == [4.0, 4.0]
    again = streaming.GrowingTrajectories({"path": str(path)})  # a restart knows offsets alone
    assert len(_read(again, again.initialOffset(), then)) == 5


def test_growing_folder(spark, tmp_path):
    """A file comes, another grows: each frame is read once, also by a query that is started anew."""
    def raw(k, n, first=0):
        return b"".join(trajectories.Xtc.write(trajectories.Frame(t, t, None, np.full((12, 3), 10.0 * k + t))) for t in range(first, first + n))

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.xtc").write_bytes(raw(1, 3))
    (folder / "c.xtc").write_bytes(raw(3, 2)[:-8])  # one frame, and one that is not whole
    trajectories.register(spark)

    def run():
        stream = spark.readStream.format("trajectory").load(str(folder)).select("traj", "frame", "time", F.col("x")[0].alias("x"))
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted((r["traj"][-5:], r["frame"], r["time"], round(r["x"])) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run() == [("a.xtc", k, k, 10 + k) for k in range(3)] + [("c.xtc", 0, 0, 30)]
    (folder / "b.xtc").write_bytes(raw(2, 4))
    (folder / "c.xtc").write_bytes(raw(3, 5))
    (folder / "d.xtc").write_bytes(b"")
    expected = [(f"{name}.xtc", k, k, 10 * own + k) for name, own, n in (("a", 1, 3), ("b", 2, 4), ("c", 3, 5)) for k in range(n)]
    assert run() == expected and run() == expected


def test_windowed_means(spark, tables, tmp_path):
    points = spark.read.parquet(f"{tables}/events.parquet").select("ts", F.col("user_id").alias("atom"), "value")
    points.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(points.schema).parquet(str(tmp_path / "in"))
    q = streaming.windowed_means(stream, "10 minutes", "1 day").writeStream.format("memory").queryName("means").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r["start"], r["atom"]): (r["n"], round(r["mean"], 6)) for r in spark.table("means").collect()}
    expected = points.withColumn("ts", F.col("ts").cast("timestamp")).groupBy(F.window("ts", "1 day").start.alias("start"), "atom").agg(F.count("value").alias("n"), F.avg("value").alias("mean")).collect()
    assert got == {(r["start"], r["atom"]): (r["n"], round(r["mean"], 6)) for r in expected}
