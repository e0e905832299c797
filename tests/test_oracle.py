"""Every query with a SQL counterpart gives the same rows as DuckDB on the given tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as driver
from tellmark.plans import oracle

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TABLES = "documents embeddings benchmark labels conversations".split()
STATEMENTS = oracle.statements()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def canonical(columns, rows):
    def value(x):
        if isinstance(x, float):
            return "nan" if math.isnan(x) else round(x, 6) + 0.0
        return float(x) if isinstance(x, int) else x

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(value(row[i]) for i in order) for row in rows), key=repr)


def test_every_statement_has_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())


@pytest.mark.parametrize("name", sorted(STATEMENTS))
def test_matches_sql(spark, duck, name):
    got = driver.queries()[name](spark, FOLDER)
    found = duck.execute(STATEMENTS[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(got.columns)
    assert canonical(got.columns, got.collect()) == canonical(columns, found.fetchall())


def test_flagship(spark):
    rows = driver.entry(spark).collect()
    assert len(rows) == 7 and {r["gate_passed"] for r in rows} == {0}
