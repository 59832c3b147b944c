"""Every evidence query against its SQL on the smallest tables, rows as multisets."""

import duckdb
import pytest

from tessera.plans import archives, catalog, lines, live, rules, sampling, shapes, stateful, statistics, surfaces  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    with duckdb.connect() as c:
        for t in catalog.TABLES:
            c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
        yield c


def plain(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows_as_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    expected = duck.sql(catalog.oracle_sql()[name])
    assert sorted(expected.columns) == columns
    at = [expected.columns.index(c) for c in columns]
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(plain(r[i]) for i in at) for r in expected.fetchall())
