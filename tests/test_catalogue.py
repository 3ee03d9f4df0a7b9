"""Every catalogued query against its SQL text on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from knotwork.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def rows(values, columns, order):
    at = [columns.index(c) for c in order]
    return sorted(tuple(repr(r[i]) for i in at) for r in values)


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, sf_dir, con, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    assert got
    if name in catalogue.ORACLES:
        rel = con.sql(catalogue.ORACLES[name])
        order = sorted(df.columns)
        assert sorted(rel.columns) == order
        assert rows(got, df.columns, order) == rows(rel.fetchall(), rel.columns, order)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
