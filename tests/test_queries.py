"""Every query with an oracle against DuckDB on the smallest test tables."""

import datetime
import glob
import math
import os

import duckdb
import pytest

from loomcorpus.plans import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return str(v) if isinstance(v, datetime.datetime) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_oracle(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    r = duck.execute(catalog.SQL[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(x[names.index(c)]) for c in cols) for x in r.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, name):
    if not os.path.exists(catalog.BPE_FILE):
        pytest.skip("no vocabulary file")
    rows = catalog.QUERIES[name](spark, DATA).collect()
    assert rows
    if name == "nested_family":
        assert all(r.violations == 0 for r in rows)
    if name == "bpe_profile":
        assert all(r.lossy == 0 for r in rows)
    if name == "bpe_chunks":
        assert all(r.tokens <= 510 for r in rows)
    if name == "bpe_blocks":
        assert all(len(r.ids) == 512 for r in rows)
