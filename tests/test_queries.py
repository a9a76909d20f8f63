"""Every core query against its SQL on the smallest test tables."""

import decimal
import os

import pytest

from marlinspike.plans import catalog

DIR = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6)
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DIR):
        c.execute(f"create view {f.removesuffix('.parquet')} as from '{DIR}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, con, name):
    df = catalog.queries()[name](spark, DIR)
    rows = sorted(repr([plain(x) for x in r]) for r in df.select(*sorted(df.columns)).collect())
    if name in catalog.sql():
        rel = con.execute(catalog.sql()[name])
        names = [d[0] for d in rel.description]
        order = [names.index(c) for c in sorted(names)]
        assert sorted(names) == sorted(df.columns)
        assert rows == sorted(repr([plain(r[i]) for i in order]) for r in rel.fetchall())
