"""Mean square displacements of tracks that are longer than a block."""

import numpy as np
import pytest

from trajix.operators import over_time


@pytest.mark.parametrize("n", [1, 64, 203])
def test_msd_in_blocks(spark, n):
    rng = np.random.default_rng(1)
    r = np.cumsum(rng.normal(size=(n, 2, 3)), axis=0) + 100
    numbers = np.sort(rng.choice(10_000, n, replace=False))
    rows = [(int(k), *x.T.tolist()) for k, x in zip(numbers, r)]
    frames = spark.createDataFrame([rows[k] for k in rng.permutation(n)], "frame bigint, x array<double>, y array<double>, z array<double>")
    got = {x["lag"]: x["value"] for x in over_time.msd(frames, block=16).collect()}
    assert sorted(got) == list(range(n))
    for lag in range(n):
        assert got[lag] == pytest.approx((((r[lag:] - r[: n - lag]) ** 2).sum(2)).mean(), rel=1e-9, abs=1e-9)
