"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

from quillspark.plans import registry

registry.load()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _rows(frame):
    frame = frame[sorted(frame)]
    return sorted(map(tuple, frame.astype(object).where(frame.notna(), None).astype(str).values.tolist()))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_equals_sql(spark, db, sf, name):
    mine = registry.QUERIES[name](spark, sf).toPandas()
    theirs = db.sql(registry.ORACLE_SQL[name]).df()
    assert sorted(mine) == sorted(theirs)
    assert _rows(mine) == _rows(theirs)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_has_rows(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0
