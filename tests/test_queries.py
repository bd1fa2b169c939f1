"""Every registered query of the reference's own operators against its SQL."""

import pytest

duckdb = pytest.importorskip("duckdb")
from quire.plans import documents, relational, structure  # noqa: E402

QUERIES = relational.QUERIES | structure.QUERIES | documents.QUERIES
SQL = relational.SQL | structure.SQL | documents.SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def plain(rows):
    one = lambda x: repr(float(x)) if isinstance(x, float) or type(x).__name__ == "Decimal" else str(x)
    return sorted(tuple(one(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, sf_dir, name):
    want = con.execute(SQL[name])
    columns = [d[0] for d in want.description]
    got = QUERIES[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(columns)
    rows = plain(want.fetchall())
    assert plain(got.select(columns).collect()) == rows
    assert rows or name in SPARSE


#: Queries without a row on the smallest tables.
SPARSE: set[str] = set()
