"""The registered queries are listed without a Spark session."""

from __future__ import annotations

import subprocess
import sys

from tests.conftest import ROOT

LISTING = """
import __spark_entry__
from pyspark import SparkContext

names = set(__spark_entry__.queries())
assert set(__spark_entry__.oracle_sql()) <= names
assert {"pipeline", "op4_token_files", "merged_a01_conflict_heatmap"} <= names
assert SparkContext._active_spark_context is None
"""


def test_queries_are_listed_before_a_session_starts():
    done = subprocess.run([sys.executable, "-c", LISTING], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
