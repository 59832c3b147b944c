import duckdb
import pytest

from tessera.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", queries.oracle_sql())
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    wanted = con.execute(queries.oracle_sql()[name])
    columns = sorted(x[0] for x in wanted.description)
    place = [[x[0] for x in wanted.description].index(c) for c in columns]
    expected = sorted((tuple(r[i] for i in place) for r in wanted.fetchall()), key=str)
    got = queries.queries()[name](spark, FOLDER)
    assert sorted(got.columns) == columns
    assert sorted(map(tuple, got.select(*columns).collect()), key=str) == expected
