"""Every query against its SQL, at the smallest size."""

import duckdb
import pytest

from cairn.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
SQL = catalog.oracle_sql()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([r[i] for i in order] for r in data), key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, con, name):
    out = catalog.queries()[name](spark, SF)
    got = [tuple(r) for r in out.collect()]
    if name not in SQL:
        assert len(got) > 0
        return
    rel = con.sql(SQL[name])
    assert {c: str(t) for c, t in zip(rel.columns, rel.types)} == {c: TYPES.get(t, t) for c, t in out.dtypes}
    assert rows(out.columns, got) == rows(rel.columns, rel.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
