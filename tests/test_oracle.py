"""Every registered query against its SQL twin in DuckDB."""

from __future__ import annotations

import math

import duckdb
import pytest

import __spark_entry__
from parity.catalog import catalog
from tests.conftest import TESTDATA

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

CATALOG = catalog()
# Nothing reaches the thresholds of these at the smallest scale.
AT_LARGER_SCALE = [n for n in CATALOG if "breaking" in n] + ["a15_source_diversity_index", "a09_escalation_events"]

pytestmark = pytest.mark.skipif(not TESTDATA.exists(), reason="shared test tables are absent")


def connection(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return ""
    return repr(float(value)) if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)


def values(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(plain(row[i]) for i in order) for row in rows])


def compare(spark, name, sf):
    sf_dir = str(TESTDATA / f"sf{sf}")
    query, sql = CATALOG[name]
    df = query(spark, sf_dir)
    got = df.collect()
    cursor = connection(sf_dir).execute(sql)
    names = [column[0] for column in cursor.description]
    assert sorted(df.columns) == sorted(names)
    assert values(got, df.columns) == values(cursor.fetchall(), names)
    return len(got)


@pytest.mark.parametrize("name", [n for n, (_, sql) in CATALOG.items() if sql is not None])
def test_matches_sql(spark, name):
    compare(spark, name, "0.001")


@pytest.mark.parametrize("name", AT_LARGER_SCALE)
def test_matches_sql_where_thresholds_fire(spark, name):
    assert compare(spark, name, "0.01") > 0


def test_contract(spark):
    names, with_sql = set(__spark_entry__.queries()), set(__spark_entry__.oracle_sql())
    assert set(CATALOG) <= with_sql <= names
    assert len([n for n in names if n.startswith("a")]) >= 19
    assert __spark_entry__.entry(spark).count() > 0
