"""Every registered query of the code graph against its SQL, at the smallest scale."""

from pathlib import Path

import duckdb
import pytest

from loomgraph.plans import fixture, registry

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.is_dir(), reason="the tables are not here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for t in fixture.TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLES)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    got = registry.QUERIES[name](spark, str(DATA))
    want = con.sql(registry.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    pick = lambda names, rows: sorted(repr([r[names.index(c)] for c in columns]) for r in rows)
    assert pick(got.columns, [tuple(r) for r in got.collect()]) == pick(want.columns, want.fetchall())


def test_entry():
    import __spark_entry__

    assert set(registry.QUERIES) <= set(__spark_entry__.queries())
