import os

import duckdb
import pytest

from loomgraph.llm import queries, sql

D = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(D), reason="no tables")
@pytest.mark.parametrize("name", [n for n in sql.ORACLES if n != "op2_perspective_rotation"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS FROM '{D}/{t}.parquet'")
    df = queries.QUERIES[name](spark, D)
    cols = sorted(df.columns)
    rel = con.sql(sql.ORACLES[name])
    at = [rel.columns.index(c) for c in cols]
    assert sorted(rel.columns) == cols
    assert sorted(repr(tuple(r[c] for c in cols)) for r in df.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in rel.fetchall())
