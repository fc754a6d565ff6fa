"""Queries that have SQL against it, on the smallest tables."""

import duckdb
import pytest
from weftline.llm import queries

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "pages"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    df, rel = queries.QUERIES[name](spark, SMALL), duck.sql(queries.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    ours = sorted(tuple(str(r[c]) for c in sorted(df.columns)) for r in df.collect())
    order = sorted(range(len(rel.columns)), key=lambda i: rel.columns[i])
    assert ours == sorted(tuple(str(r[i]) for i in order) for r in rel.fetchall())
