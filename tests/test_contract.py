"""The driver's contract: queries agree with their SQL, and plans are what they should be."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from lexloom.operators import search
from lexloom.plans import catalog, stores  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle(small_dir):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{small_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small_dir}/{t}.parquet'")
    return con


def norm(value):
    return round(value, 6) if isinstance(value, float) else str(value) if isinstance(value, bool) else value


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_agrees_with_its_sql(spark, small_dir, oracle, name):
    df = catalog.QUERIES[name](spark, small_dir)
    columns = sorted(df.columns)
    mine = sorted(repr(tuple(norm(r[c]) for c in columns)) for r in df.collect())
    rel = oracle.sql(catalog.ORACLE_SQL[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert mine == sorted(repr(tuple(norm(r[i]) for i in at)) for r in rel.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_other_queries_run(spark, small_dir, name):
    assert catalog.QUERIES[name](spark, small_dir).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns
    assert set(entry.oracle_sql()) <= set(entry.queries())


def plan(df):
    return df._jdf.queryExecution().toString()


def test_search_plan(spark, small_dir):
    e, f = catalog.lexicon(spark, small_dir)
    text = plan(search.ranked_search(e, f, "Brand#13", "ring", limit=10))
    assert "StringStartsWith(p_name,ring)" in text and "EqualTo(p_brand,Brand#13)" in text
    assert "TakeOrderedAndProject" in text and "WindowGroupLimit" in text
    assert "Python" not in text and "p_retailprice" not in text.split("== Physical Plan ==")[1]
