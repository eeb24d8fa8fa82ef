"""A local session for all tests, and comparison of a query with its SQL."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    return SF


def plain(v):
    """A value without the differences of two engines' Python types."""
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if v is None or v != v:
        return None
    if isinstance(v, float):
        return int(v) if abs(v) < 1e15 and v == int(v) else v
    return v


def rows_of(df, columns):
    return sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())


@pytest.fixture(scope="session")
def same_as_sql(spark, sf):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")

    def check(query, sql, tables=None):
        for name, frame in (tables or {}).items():
            con.register(name, frame)
        df = query(spark, sf)
        got = con.execute(sql)
        names = [d[0] for d in got.description]
        assert sorted(names) == sorted(df.columns)
        cols = sorted(names)
        theirs = sorted(repr([plain(dict(zip(names, r, strict=True))[c]) for c in cols]) for r in got.fetchall())
        assert rows_of(df, cols) == theirs

    return check
