from __future__ import annotations

import os
import sys
from datetime import datetime, timezone
from pathlib import Path

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
# Python workers of the streaming detectors import nothing from here, but CLI tests do.
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), os.environ.get("PYTHONPATH", "")])

TESTDATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]").appName("tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoint")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture
def now():
    return datetime(2024, 3, 5, 12, 30, tzinfo=timezone.utc)


def table(spark, name: str, rows: list[dict]):
    """Rows in the full raw schema; absent columns are null."""
    from wirepulse.schema import raw_schema

    schema = raw_schema(name)
    return spark.createDataFrame([tuple(row.get(c) for c in schema.names) for row in rows], schema)


@pytest.fixture
def events_of(spark):
    """Events from dicts, with ids and a country filled in unless given."""

    def make(*rows: dict):
        filled = [
            {"GlobalEventID": i, "ActionGeo_CountryCode": "FR", "Day": 20240229, "DATEADDED": "20240229120000", **row}
            for i, row in enumerate(rows)
        ]
        return table(spark, "events", filled)

    return make


@pytest.fixture
def mentions_of(spark):
    """Mentions from (event id, time stamp) or (event id, time stamp, source)."""

    def make(*rows: tuple):
        return table(spark, "mentions", [
            {"GlobalEventID": r[0], "MentionTimeDate": r[1], "MentionSourceName": r[2] if len(r) > 2 else "src"}
            for r in rows
        ])

    return make


@pytest.fixture
def gkg_of(spark):
    return lambda *rows: table(spark, "gkg", list(rows))


def rows_of(df, *columns):
    """Sorted tuples of a DataFrame."""
    out = [tuple(r) for r in (df.select(*columns) if columns else df).collect()]
    return sorted(out, key=lambda row: tuple((v is not None, str(v)) for v in row))


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


__all__ = ["F", "plan_of", "rows_of", "table"]
