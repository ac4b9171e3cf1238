"""Every registered query of the engine against its SQL."""

import os

import duckdb
import pytest

from morphlake import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{DATA}/{name}.parquet')")
    return con


def _rows(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple("" if r[k] is None else repr(float(r[k])) if isinstance(r[k], float) else str(r[k]) for k in order) for r in rows))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query(spark, sql, name):
    df = catalog.QUERIES[name](spark, DATA)
    want = sql.execute(catalog.ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(names)
    assert _rows(df.columns, df.collect()) == _rows(names, want.fetchall())


def test_names():
    assert catalog.ORACLE_SQL.keys() <= catalog.QUERIES.keys()
