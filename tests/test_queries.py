"""Every query of the engine against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from causeway.plans import queries as Q

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for p in glob.glob(f"{DIR}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def _plain(rows):
    return sorted(repr(tuple(round(float(v), 6) if isinstance(v, float) else v for v in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(spark, db, name):
    got = Q.queries()[name](spark, DIR)
    columns = sorted(got.columns)
    rows = [tuple(r[c] for c in columns) for r in got.collect()]
    if name not in Q.oracle_sql():
        assert rows
        return
    want = db.execute(Q.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert _plain(rows) == _plain([tuple(r[i] for i in at) for r in want.fetchall()])
