"""Every query against its SQL on the smallest tables; those without SQL give the same rows and schema again, with the rows dealt otherwise."""

import glob
import os

import duckdb
import pytest

from cuelake.plans import registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    frame = frame.astype(object).where(frame.notna(), None)
    return sorted(tuple(str(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r) for r in frame.itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, db):
    df = QUERIES[name](spark, DATA)
    got = df.toPandas()
    if name in SQL:
        want = db.sql(SQL[name]).df()
    else:
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
        try:
            again = QUERIES[name](spark, DATA)
            want = again.toPandas()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert again.schema == df.schema
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
