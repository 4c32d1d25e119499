"""Plans that should hold at any size: pruned scans, pushed filters, no window or join over raw groups."""

from __future__ import annotations

import re

import pytest

from tests.conftest import plan_of, table
from wirepulse.operators import media
from wirepulse.session import materialise, scratch_path
from wirepulse.plans.registry import ANALYSES, SHARED_COLUMNS
from wirepulse.sources import landed
from wirepulse.streaming import refresh

PUSHED = {
    "conflict_heatmap": ("GreaterThanOrEqual(QuadClass,3)", "IsNotNull(ActionGeo_CountryCode)"),
    "tone_source_correlation": ("IsNotNull(AvgTone)", "IsNotNull(NumSources)"),
    "actor_interaction_matrix": ("IsNotNull(Actor1Type1Code)", "IsNotNull(Actor2Type1Code)"),
    "conflict_pairs": ("GreaterThanOrEqual(QuadClass,3)", "IsNotNull(Actor1CountryCode)"),
    "ethnic_conflicts": ("GreaterThanOrEqual(QuadClass,3)",),
    "top_organizations": ("IsNotNull(Organizations)",),
    "source_diversity_index": ("IsNotNull(MentionSourceName)", "IsNotNull(GlobalEventID)"),
    "top_article_coverage": ("IsNotNull(NumArticles)",),
}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    from datetime import datetime

    out = str(tmp_path_factory.mktemp("landed"))
    for name in ("events", "mentions", "gkg"):
        landed.land(table(spark, name, [{}]), name, out, datetime(2024, 1, 1))
    return landed.read_tables(spark, out)


@pytest.fixture(scope="module")
def plans(spark, tables):
    """Plans with automatic broadcasts off, as for inputs of any size."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return {name: plan_of(analysis.run(tables)) for name, analysis in ANALYSES.items()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("name", list(ANALYSES))
def test_no_quadratic_join_no_python_no_wide_scan(plans, name):
    plan = plans[name]
    for operator in ("CartesianProduct", "NestedLoopJoin", "Python", "Pandas", "SinglePartition"):
        assert operator not in plan
    for columns in re.findall(r"ReadSchema: struct<([^>]*)>", plan):
        assert len(columns.split(",")) <= 9


@pytest.mark.parametrize("name", list(ANALYSES))
def test_windows_run_on_aggregates(plans, name):
    lines = plans[name].splitlines()
    for number, text in enumerate(lines):
        if re.match(r"[\s:+\-]*(\*\(\d+\) )?Window", text):
            below = "\n".join(lines[number:])
            assert "HashAggregate" in below


@pytest.mark.parametrize("name", list(PUSHED))
def test_filters_reach_the_scan(spark, tables, name):
    plan = plan_of(ANALYSES[name].run(tables))
    text = ANALYSES[name].run(tables)._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    assert "FileScan parquet" in plan
    for condition in PUSHED[name]:
        assert condition in text


def test_only_fixed_tables_are_broadcast_unasked(plans):
    broadcast = {name for name, plan in plans.items() if "BroadcastExchange" in plan}
    assert broadcast == {"cameo_distribution", "religion_conflict_cluster", "gkg_themes_continent"}


def test_staged_bursts_are_broadcast_only_by_size(spark, tables):
    def plan():
        bursts = materialise(media.first_hour_bursts(tables["mentions"]), scratch_path(spark, "bursts"))
        return plan_of(media.locate_bursts(bursts, tables["events"]))

    assert "LeftSemi, BuildRight" in plan()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" not in plan() and "SortMergeJoin" in plan()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_one_hot_story_enters_the_join_preaggregated(plans):
    plan = plans["source_diversity_index"]
    assert plan.count("HashAggregate(keys=[GlobalEventID") == 2


def test_refresh_prunes_history_by_day(spark, tables):
    days = spark.createDataFrame([(20240101,), (20240103,)], "_day int")
    plan = refresh.events_of_days(tables["events"], days, "published")._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    assert "GreaterThanOrEqual(DATEADDED,20240101)" in plan and "LessThan(DATEADDED,20240103:)" in plan
    odd = spark.createDataFrame([(20240101,), (None,)], "_day int")
    plan = plan_of(refresh.events_of_days(tables["events"], odd, "published"))
    assert "GreaterThanOrEqual(DATEADDED,20240101)" in plan


def test_refresh_reads_exact_days_years_apart(spark, tables):
    days = spark.createDataFrame([(20140101,), (20240103,), (None,)], "_day int")
    touched = refresh.events_of_days(tables["events"], days, "event")
    plan = touched._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    pushed = plan[plan.index("PushedFilters"):].split("\n")[0]
    assert "20140101" in pushed and "20240103" in pushed and "IsNull(Day)" in pushed


def test_shared_columns_cover_the_inputs(tables):
    narrow = tables | {name: tables[name].select(*columns) for name, columns in SHARED_COLUMNS.items()}
    for analysis in ANALYSES.values():
        assert analysis.run(narrow).columns == analysis.run(tables).columns
