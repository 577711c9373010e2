"""Queries of the subpackage on the smallest test tables, where these are at hand."""

import os

import pytest

from sensorframe.llm import queries as Q

FOLDER = os.environ.get("SENSORFRAME_TESTDATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(spark, name):
    df = Q.queries()[name](spark, FOLDER)
    got = sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=repr)
    assert got
    if name in Q.oracle_sql():
        import duckdb

        c = duckdb.connect()
        for f in os.listdir(FOLDER):
            c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{FOLDER}/{f}'")
        rel = c.sql(Q.oracle_sql()[name])
        order = [rel.columns.index(x) for x in sorted(df.columns)]
        assert got == sorted((tuple(r[i] for i in order) for r in rel.fetchall()), key=repr)
