"""Every registered query against its SQL counterpart on the same tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def value(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return round(float(v), 6) if hasattr(v, "as_tuple") else v


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, duck, sf_dir, name):
    df = entry.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    rows = sorted((tuple(value(r[c]) for c in columns) for r in df.collect()), key=repr)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    result = duck.execute(sql)
    names = [d[0] for d in result.description]
    order = [names.index(c) for c in columns]
    expected = sorted((tuple(value(r[i]) for i in order) for r in result.fetchall()), key=repr)
    assert sorted(names) == columns
    assert rows == expected


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert {r["Final_Decision"]: r["n"] for r in entry.entry(spark).collect()} == {
        "APPROVED_FINAL": 13,
        "FLAGGED_FINAL": 47,
        "REJECTED_FINAL": 140,
    }
