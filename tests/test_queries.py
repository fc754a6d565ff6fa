"""Every query of the library against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest
from weftline.plans import catalogue_suite, functions_suite, operators_suite  # noqa: F401
from weftline.plans.registry import QUERIES, SQL

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


def plain(v):
    return repr(round(v, 6) + 0.0) if isinstance(v, float) else repr(int(v)) if isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    ours = sorted(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    if name not in SQL:
        assert ours
        return
    rel = duck.sql(SQL[name])
    order = sorted(range(len(rel.columns)), key=lambda i: rel.columns[i])
    assert sorted(rel.columns) == sorted(df.columns)
    assert ours == sorted(tuple(plain(r[i]) for i in order) for r in rel.fetchall())
