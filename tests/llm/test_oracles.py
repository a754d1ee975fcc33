"""The registered SQL against the registered queries."""

import duckdb
import pytest

from loomgraph.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    cur = con.execute(queries.ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(map(tuple, queries.QUERIES[name](spark, sf).select(*names).collect())) == sorted(cur.fetchall())
