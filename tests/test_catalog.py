"""Every query against its SQL."""

import datetime
import decimal
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from attrilake.plans import catalog


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}{'/*.parquet' if f.is_dir() else ''}'")
    return con


def canon(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def text(x):
        if isinstance(x, (float, decimal.Decimal)):
            return repr(round(float(x), 9))
        return x.isoformat() if isinstance(x, datetime.datetime) else str(x)

    return sorted(tuple(text(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", list(catalog.oracle_sql()))
def test_equals_sql(spark, duck, sf_dir, name):
    df = catalog.queries()[name](spark, sf_dir)
    want = duck.sql(catalog.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert canon(df.collect(), df.columns) == canon(want.fetchall(), want.columns)


def test_most_queries_find_something(spark, sf_dir):
    empty = [n for n, q in catalog.queries().items() if q(spark, sf_dir).isEmpty()]
    assert set(empty) <= {"search_no_suffix_mode", "trie_suffix"}, empty


def test_entry(spark):
    assert entry.entry(spark).columns == ["object_id"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
