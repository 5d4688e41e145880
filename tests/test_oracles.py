"""Every query of the engine against its SQL twin on the smallest tables."""

import duckdb
import pytest

from lodestar.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return connection



@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, duck, small, name):
    got = QUERIES[name](spark, small)
    columns = sorted(got.columns)
    cursor = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = [tuple(r[i] for i in at) for r in cursor.fetchall()]
    key = lambda r: tuple((v is not None, v) for v in r)
    rounded = lambda rows: sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=key)
    assert rounded(tuple(r) for r in got.select(*columns).collect()) == rounded(want)


def test_queries_without_twin_run(spark, small):
    for name in set(QUERIES) - set(ORACLE_SQL):
        assert QUERIES[name](spark, small).count() >= 0


def test_entry(spark):
    import __spark_entry__ as e

    assert [r.rank for r in e.entry(spark).collect()] == list(range(1, 11))
    assert set(e.oracle_sql()) <= set(e.queries())
