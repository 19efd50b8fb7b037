"""Every registered query of the library against its SQL in DuckDB."""

import datetime

import duckdb
import pytest

from tessera.plans import ORACLE, QUERIES

from .conftest import SF

TABLES = "documents embeddings pages benchmark labels conversations events".split()


#: Queries for a phrase that the smallest tables do not hold; over larger ones they give rows.
EMPTY = {"bm25_chunks", "bm25_filtered", "bm25_phrase", "grep_index", "grep_lines", "grep_regex", "regex_extract", "sql_search"}


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def norm(v):
    if isinstance(v, float):
        return None if v != v else round(v, 5) + 0.0
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rows = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    assert rows or name in EMPTY
    if name not in ORACLE:
        return
    got = db.execute(ORACLE[name])
    names = [x[0] for x in got.description]
    assert sorted(names) == cols
    want = sorted((tuple(norm(r[names.index(c)]) for c in cols) for r in got.fetchall()), key=repr)
    assert rows == want


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
