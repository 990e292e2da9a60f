"""Surface areas by bit masks against the plain way, and table functions against the DataFrame operators."""

import numpy as np
import pytest

from trajix.operators import sasa


@pytest.mark.parametrize("n", [64, 100, 960])
def test_masks_are_near_the_plain_way(n):
    """An atom within 6 % of its sphere, the whole within 3 %."""
    rng = np.random.default_rng(1)
    grid = np.stack(np.meshgrid(*[np.arange(7)] * 3), -1).reshape(-1, 3) * 2.3
    points = np.stack([grid + rng.normal(size=grid.shape) * s for s in (0.2, 0.5)])
    radii = rng.choice([1.2, 1.7, 1.52], len(grid)).tolist()
    plain, fast = (f(points, radii, None, 1.4, n) for f in (sasa.areas_of, sasa.areas_by_masks))
    spheres = 4 * np.pi * (np.array(radii) + 1.4) ** 2
    assert (np.abs(plain - fast) / spheres).max() < 0.06 and np.abs(plain.sum(1) / fast.sum(1) - 1).max() < 0.03


def test_masks_at_the_ends():
    far = np.array([[[0.0, 0, 0], [50, 0, 0], [0.1, 0, 0]]])
    for radii in ([1.0, 1.0, 1.0], [5.0, 1.0, 1.0]):
        plain, fast = (f(far, radii, None, 1.4, 100) for f in (sasa.areas_of, sasa.areas_by_masks))
        assert np.allclose(plain, fast, atol=0.06 * 4 * np.pi * 6.4**2) and (radii[0] == 1.0 or fast[0, 2] == plain[0, 2] == 0)
    assert sasa.areas_by_masks(far, [1.0] * 3, [1], 1.4, 100) == pytest.approx(4 * np.pi * 2.4**2)
    same = np.zeros((1, 2, 3))
    assert np.isfinite(sasa.areas_by_masks(same, [1.0, 1.0], None, 1.4, 100)).all()
    with pytest.raises(ValueError):
        sasa.areas_by_masks(far, [1.0] * 3, None, 1.4, 2000)


def test_masks_of_a_trajectory(spark, tables):
    from trajix.elements import RADII
    from trajix.plans import sample

    frames, radii = sample.frames(spark, tables), [RADII[a[2]] for a in sample.MAIN]
    plain = {r["frame"]: r["area"] for r in sasa.total_by_frame(frames, radii).collect()}
    fast = {r["frame"]: r["area"] for r in sasa.total_by_frame(frames, radii, masks=True).collect()}
    assert plain.keys() == fast.keys() and max(abs(plain[k] / fast[k] - 1) for k in plain) < 0.03
    assert sasa.sasa(frames.where("frame < 3"), radii, [0, 4], masks=True).count() == 6


def test_table_functions(spark, tables):
    """Each function gives what its operator does; with PARTITION BY each trajectory has its own reference."""
    from pyspark.sql import functions as F

    from trajix.functions.tables import register
    from trajix.operators import geometry, superposition
    from trajix.plans import sample

    register(spark)
    frames = sample.trajectories(spark, tables)
    found = {(r["traj"], r["frame"]): r["value"] for r in spark.sql("SELECT * FROM frame_rmsd(TABLE(SELECT * FROM {f}) PARTITION BY traj ORDER BY frame)", f=frames.repartition(5)).collect()}
    assert len(found) == frames.count()
    for traj in [r["traj"] for r in frames.select("traj").distinct().orderBy("traj").limit(3).collect()]:
        own = frames.where(F.col("traj") == traj)
        first = own.agg(F.min("frame")).first()[0]
        for r in superposition.rmsd(own, superposition.reference_of(own, first)).collect():
            assert found[traj, r["frame"]] == pytest.approx(r["value"], abs=1e-9)
    sql = spark.sql("SELECT * FROM frame_distances(TABLE(SELECT * FROM {f}), '0-1,3-17')", f=frames)
    got = {(r["frame"], r["i"], r["j"]): r["distance"] for r in sql.collect()}
    pairs = [(0, 1), (3, 17)]
    assert got == {(r["frame"], *pairs[r["pair"]]): pytest.approx(r["value"]) for r in geometry.distances(frames, pairs).collect()}
    assert spark.sql("SELECT * FROM frame_gyration(TABLE(SELECT * FROM {f}), CAST(NULL AS ARRAY<DOUBLE>))", f=frames).count() == len(found)
    assert spark.sql("SELECT * FROM frame_neighbours(TABLE(SELECT * FROM {f}), 3.0D)", f=frames.where("false")).count() == 0
