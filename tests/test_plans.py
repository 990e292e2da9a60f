"""Every registered query of the trajectory operators against its SQL."""

import pytest

from trajix.plans.oracle import ORACLE_SQL
from trajix.plans.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, tables, duck, same, name):
    same(QUERIES[name](spark, tables), duck, ORACLE_SQL[name])


def test_entry_and_registry(spark, tables):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 500
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert QUERIES.keys() <= entry.queries().keys()


def test_pca_against_numpy(spark, tables):
    import numpy as np

    from trajix.operators import over_time
    from trajix.plans import sample

    frames = sample.frames(spark, tables)
    rows = frames.orderBy("frame").collect()
    r = np.stack([np.stack([np.array(x[c]) for c in "xyz"], 1) for x in rows])[:, [0, 3, 7]].reshape(len(rows), -1)
    values = np.linalg.eigvalsh(np.cov(r.T))[::-1]
    head, loads = over_time.pca(frames, [0, 3, 7], 4)
    assert np.allclose([x["eigenvalue"] for x in head.orderBy("component").collect()], values[:4])
    assert loads.count() == 4 * 9
