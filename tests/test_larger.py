"""Queries on tables larger or denser than the given ones, against their SQL."""

import duckdb
import pytest

from tessera.plans import catalog, lines, live, rules, sampling, shapes, surfaces  # noqa: F401
from tessera.streaming import lakes

SF = "/root/testdata/sf0.001"


def plain(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


def same_as_sql(spark, folder, name, **tables):
    """The query on sf0.001 with some tables made by ``select`` statements instead."""
    with duckdb.connect() as c:
        for t in catalog.TABLES:
            source = f"{SF}/{t}.parquet"
            if t in tables:
                source = f"{folder}/{t}.parquet"
                c.execute(f"copy ({tables[t].format(sf=SF)}) to '{source}' (format parquet)")
            else:
                (folder / f"{t}.parquet").symlink_to(source)
            c.execute(f"create view {t} as select * from '{source}'")
        df = catalog.queries()[name](spark, str(folder))
        columns = sorted(df.columns)
        expected = c.sql(catalog.oracle_sql()[name])
        at = [expected.columns.index(x) for x in columns]
        want = sorted(tuple(plain(r[i]) for i in at) for r in expected.fetchall())
    got = sorted(tuple(plain(r[x]) for x in columns) for r in df.collect())
    assert got == want
    return got


def test_reach_beyond_a_byte(spark, tmp_path):
    got = same_as_sql(spark, tmp_path, "r16_survey_reach", part="select p.* replace (p_partkey + i * 1000000 as p_partkey) from '{sf}/part.parquet' p cross join range(2) r(i)")
    assert max(int(r[2]) for r in got) > 250


def test_soundings_just_600_from_a_middle(spark, tmp_path):
    """Of 2,000 soundings many lie on multiples of 400, which belong to four rows of sections."""
    got = same_as_sql(spark, tmp_path, "p43_surprise_score", supplier="select s.* replace (s_suppkey + i * 10 as s_suppkey, abs(hash(s_suppkey + i * 10)) % 9000::double as s_acctbal) from '{sf}/supplier.parquet' s cross join range(200) r(i)")
    assert len(got) > 20


@pytest.mark.parametrize("name", ["t8s_upload_answers", "t8s_server_merge"])
def test_large_lakes_are_merged_whole(spark, tmp_path, monkeypatch, name):
    """The queries' lakes have no bounds, as their SQL has none; the operator's own stay."""
    monkeypatch.setattr(lakes.Lakes.__init__, "__defaults__", (10, 5))
    same_as_sql(spark, tmp_path, name)
