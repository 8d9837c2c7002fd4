"""Every registered query against its SQL, as the driver compares them."""

import duckdb
import pytest

import __spark_entry__
from loomwright.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", catalogue.QUERIES)
def test_query_equals_its_sql(spark, sf_dir, con, name):
    d = catalogue.QUERIES[name](spark, sf_dir)
    columns = sorted(d.columns)
    rows = sorted(tuple(repr(r[c]) for c in columns) for r in d.collect())
    if name not in catalogue.ORACLE:
        assert rows
        return
    cur = con.execute(catalogue.ORACLE[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == columns
    assert rows == sorted(tuple(repr(r[names.index(c)]) for c in columns) for r in cur.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_sql_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
