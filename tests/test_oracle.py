import glob
import os

import pytest

from specloom.plans import registry as R

D = "/root/testdata/sf0.001"


def norm(x):
    if x is None or x != x:
        return None
    return round(float(x), 9) if isinstance(x, (int, float)) and not isinstance(x, bool) else x


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in glob.glob(f"{D}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")
@pytest.mark.parametrize("name", sorted(R.QUERIES))
def test_query(spark, duck, name):
    rows = R.QUERIES[name](spark, D).collect()
    if name not in R.ORACLE_SQL:
        return
    cur = duck.execute(R.ORACLE_SQL[name])
    cols = [x[0] for x in cur.description]
    want = sorted(repr([norm(v) for _, v in sorted(zip(cols, r))]) for r in cur.fetchall())
    got = sorted(repr([norm(r[c]) for c in sorted(cols)]) for r in rows)
    assert got == want
