import glob
import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables():
    return TABLES


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{TABLES}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.fixture(scope="session")
def same():
    """Whether a DataFrame has the rows, by column name, that a DuckDB query gives."""

    def compare(df, con, sql):
        cur = con.execute(sql)
        names = [c[0] for c in cur.description]
        assert sorted(names) == sorted(df.columns)
        shown = lambda v: round(v, 5) + 0.0 if isinstance(v, float) else v
        expected = sorted((tuple(shown(dict(zip(names, r))[c]) for c in sorted(names)) for r in cur.fetchall()), key=repr)
        got = sorted((tuple(shown(r[c]) for c in sorted(names)) for r in df.collect()), key=repr)
        assert len(got) == len(expected)
        for a, b in zip(got, expected):
            assert all(x == y or isinstance(x, float) and abs(x - y) < 2e-5 for x, y in zip(a, b)), (a, b)

    return compare
