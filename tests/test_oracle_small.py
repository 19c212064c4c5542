"""Every registered query against its DuckDB oracle on the smallest tables."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as E  # noqa: E402
from oracle_check import TABLES, digest  # noqa: E402

from lisible.plans.registry import all_oracle_sql, all_queries  # noqa: E402

SF = "/root/testdata/sf0.001"
SQL = all_oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


#: Queries without a SQL form, each held against a plain implementation in a test of its own.
WITHOUT_SQL = {"level_model", "ordinal_articles", "word_substitutes", "lexical_sentences"}


def test_every_query_has_oracle():
    assert set(all_queries()) == set(SQL) | WITHOUT_SQL and not set(SQL) & WITHOUT_SQL
    assert set(SQL) <= set(E.queries()) and set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, con, name):
    df = all_queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    cur = con.execute(SQL[name])
    ocols = [d[0] for d in cur.description]
    orows = cur.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(rows) == len(orows)
    assert digest(df.columns, rows)[0] == digest(ocols, orows)[0]


def test_entry_runs(spark):
    out = E.entry(spark)
    assert out.count() > 0
    assert out.columns == ["article_id", "title", "image", "description", "level", "minutes", "band"]
