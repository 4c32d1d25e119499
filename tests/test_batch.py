"""Batch runs, result sets, the run log, serving views and the command line."""

from __future__ import annotations

import json
from pathlib import Path

import pytest

from tests.conftest import rows_of, table
from wirepulse.cli import build_parser, main
from wirepulse.operators import sentiment, views
from wirepulse.plans import batch, registry, results
from wirepulse.plans.registry import ANALYSES, Analysis, in_group
from wirepulse.session import scratch_path, shared_dir
from wirepulse.sources import landed


@pytest.fixture(scope="module")
def tables(spark):
    countries = ["US", "FR", "ZZ", None]
    events = table(spark, "events", [
        {"GlobalEventID": i, "Day": 20240101 + i % 3, "DATEADDED": f"202401{1 + i % 4:02}000000",
         "ActionGeo_CountryCode": countries[i % 4], "QuadClass": [1, 2, 3, 4, None][i % 5],
         "GoldsteinScale": i % 7 - 3.0, "AvgTone": i % 5 - 2.0 if i % 6 else None, "NumMentions": i % 4,
         "NumSources": 1 + i % 3, "NumArticles": i % 9 or None, "EventRootCode": f"{1 + i % 20:02}",
         "Actor1CountryCode": "ABC"[i % 3], "Actor2CountryCode": "BCD"[i % 3 - i % 2],
         "Actor1EthnicCode": ["x", "", None][i % 3], "Actor2EthnicCode": ["y", "x"][i % 2],
         "Actor1Religion1Code": ["r", None][i % 2], "Actor1Type1Code": "GOV", "Actor2Type1Code": "MIL"}
        for i in range(240)
    ])
    mentions = table(spark, "mentions", [
        {"GlobalEventID": i % 3, "MentionTimeDate": f"20240101{i % 2:02}0000", "MentionSourceName": f"s{i % 5}"}
        for i in range(900)
    ])
    gkg = table(spark, "gkg", [
        {"DATE": "20240101000000", "V2Themes": f"T{i % 4},1;", "V2Locations": "1#P#FR#", "Organizations": "a;b"}
        for i in range(20)
    ])
    return {"events": events, "mentions": mentions, "gkg": gkg}


def test_registry_is_complete():
    assert [a.key for a in ANALYSES.values()] == [f"A{i:02}" for i in range(1, 20)]
    assert sum(len(in_group(group)) for group in registry.GROUPS) == len(in_group("all")) == 19
    with pytest.raises(ValueError):
        in_group("other")


@pytest.mark.parametrize("name", [a.result for a in ANALYSES.values() if a.rollup])
def test_rollup_gives_the_same_result(tables, name):
    from wirepulse.operators.rollups import ROLLUPS

    analysis = ANALYSES[name]
    shared = analysis.from_rollup(ROLLUPS[analysis.rollup](tables["events"]))
    alone = analysis.run(tables)
    assert shared.schema == alone.schema
    got, expected = rows_of(shared), rows_of(alone)
    assert len(got) == len(expected) > 0
    for one, other in zip(got, expected, strict=True):
        assert one == pytest.approx(other)


def test_run_writes_every_result_and_logs(spark, tables, tmp_path):
    out = str(tmp_path)
    assert batch.run_analyses(spark, tables, out, ordered=True) == list(ANALYSES)
    written = results.read_results(spark, out)
    for analysis in ANALYSES.values():
        expected = analysis.run(tables)
        assert written[analysis.result].columns == expected.columns
        assert written[analysis.result].count() == expected.count()
    counts = dict(rows_of(views.row_counts(written)))
    assert len(counts) == 19 and counts["breaking_news"] == 3
    assert rows_of(results.run_log(spark, out), "status", "failed") == [("success", None)]
    batch.run_analyses(spark, tables, out, "conflicts", share=False)
    assert results.run_log(spark, out).count() == 2
    assert not list(Path(shared_dir(spark)).glob("wirepulse/rollups-*"))
    again = results.read_result(spark, out, "conflict_heatmap")
    assert again.count() == counts["conflict_heatmap"]


def test_cached_run_needs_only_the_shared_columns(spark, tables, tmp_path):
    batch.run_analyses(spark, tables, str(tmp_path), share=False, cache=True)
    assert results.run_log(spark, str(tmp_path)).first()["status"] == "success"
    assert results.read_result(spark, str(tmp_path), "breaking_news").count() == 3


def test_a_failing_analysis_is_logged_and_others_are_written(spark, tables, tmp_path, monkeypatch):
    def broken(_events):
        return tables["events"].selectExpr("raise_error('no')")

    bad = Analysis("A05", "actor_interaction_matrix", "sentiment", ("events",), broken, ())
    monkeypatch.setitem(ANALYSES, "actor_interaction_matrix", bad)
    with pytest.raises(batch.RunFailed):
        batch.run_analyses(spark, tables, str(tmp_path), "sentiment")
    assert rows_of(results.run_log(spark, str(tmp_path)), "status", "failed") == [
        ("failed", "actor_interaction_matrix"),
    ]
    assert results.read_result(spark, str(tmp_path), "sentiment_trend").count() > 0


def test_a_run_is_resumed_and_tried_again(spark, tables, tmp_path, monkeypatch):
    calls = []

    def breaks(times):
        def build(events):
            calls.append(1)
            if len(calls) <= times:
                raise ValueError("not yet")
            return tables["events"].selectExpr("GlobalEventID AS event_count")

        return Analysis("A05", "actor_interaction_matrix", "sentiment", ("events",), build, ())

    monkeypatch.setitem(ANALYSES, "actor_interaction_matrix", breaks(1))
    with pytest.raises(batch.RunFailed):
        batch.run_analyses(spark, tables, str(tmp_path), "sentiment", run_id="r1")
    first = (tmp_path / "tone_conflict_lag" / "_SUCCESS").stat().st_mtime_ns
    assert batch.run_analyses(spark, tables, str(tmp_path), "sentiment", run_id="r1") == ["actor_interaction_matrix"]
    assert batch.run_analyses(spark, tables, str(tmp_path), "sentiment", run_id="r1") == []
    assert (tmp_path / "tone_conflict_lag" / "_SUCCESS").stat().st_mtime_ns == first
    calls.clear()
    monkeypatch.setitem(ANALYSES, "actor_interaction_matrix", breaks(2))
    assert "actor_interaction_matrix" in batch.run_analyses(spark, tables, str(tmp_path), "sentiment", retries=2)
    assert len(calls) == 3


def test_write_result_formats_and_order(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (3, "b"), (2, "c")], "n long, x string")
    results.write_result(df, "one", str(tmp_path), fmt="json", sort=("-n",))
    lines = [r["value"] for r in spark.read.text(f"{tmp_path}/one").collect()]
    assert [json.loads(text)["n"] for text in lines] == [3, 2, 1]
    results.write_result(df, "two", str(tmp_path), fmt="noop")


def test_scratch_lies_in_the_shared_folder(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    assert scratch_path(spark, "x").startswith(shared_dir(spark))
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


def test_a_failure_while_building_is_logged_too(spark, tables, tmp_path, monkeypatch):
    def broken(_events):
        raise ValueError("no")

    bad = Analysis("A05", "actor_interaction_matrix", "sentiment", ("events",), broken, ())
    monkeypatch.setitem(ANALYSES, "actor_interaction_matrix", bad)
    with pytest.raises(batch.RunFailed, match="actor_interaction_matrix"):
        batch.run_analyses(spark, tables, str(tmp_path), "sentiment")
    assert results.run_log(spark, str(tmp_path)).first()["status"] == "failed"


def test_top_view(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(9)], "id long, g long")
    assert rows_of(views.top_view(df, ("-g", "id"), 2, where="id > 2", cols=["id"])) == [(5,), (8,)]
    assert views.top_view(df, limit=None).count() == 9


def test_views_cut_to_their_limits(tables):
    for view in views.VIEWS.values():
        result = ANALYSES[view.result].run(tables)
        page = view.page(result)
        assert set(name.lstrip("-") for name in view.sort) <= set(result.columns)
        assert page.count() == min(view.limit, result.count())
        assert view.shown(result).count() <= view.limit


def test_panels(spark):
    heat = spark.createDataFrame([("A", 1, -4.0), ("B", 1, 4.0), ("C", 1, 0.0), ("D", 1, None)],
                                 "country string, date int, avg_goldstein double")
    assert rows_of(views.VIEWS["V01"].shown(heat), "country", "severity") == [
        ("A", "severe"), ("B", "cooperative"), ("C", "neutral"), ("D", "neutral"),
    ]
    trend = spark.createDataFrame([(c, d) for c in "ABCD" for d in range(40)], "country string, date int")
    shown = rows_of(views.VIEWS["V07"].shown(trend))
    assert {c for c, _ in shown} == {"A", "B", "C"} and len(shown) == 90 and min(d for _, d in shown) == 10


def test_json_rows_are_limited_to_known_sets(spark):
    df = spark.createDataFrame([("FR", 1)] * 300, "country string, date int")
    assert views.table_json({"conflict_heatmap": df}, "conflict_heatmap").count() == 200
    assert views.json_rows(df, 1).first()[0] == '{"country":"FR","date":1}'
    for name in ("pipeline_runs", "breaking_news"):
        with pytest.raises(KeyError):
            views.table_json({"conflict_heatmap": df, "pipeline_runs": df}, name)


# s string, i int, l long, d double, t timestamp
RESULT_SCHEMAS = {
    "conflict_heatmap": "country s, date i, avg_goldstein d, event_count l, avg_mentions d",
    "top_news_countries": "country s, date i, event_count l, rank i",
    "tone_source_correlation": "country s, date i, avg_tone d, avg_sources d, tone_sources_correlation d, sample_size l",
    "cameo_distribution": "EventRootCode s, event_description s, region s, date i, event_count l",
    "actor_interaction_matrix": "actor1_type s, actor2_type s, event_count l, avg_goldstein d, avg_tone d",
    "media_coverage_ratio": "country s, date i, total_mentions l, total_events l, mentions_per_event d",
    "sentiment_trend": "country s, date i, avg_tone d, moving_avg_3d d",
    "conflict_pairs": "actor1_country s, actor2_country s, date i, conflict_count l, avg_goldstein d",
    "escalation_events":
        "GlobalEventID l, mention_hour t, mentions_last_24h l, mentions_this_hour l, escalation_ratio d",
    "religion_conflict_cluster": "religion s, region s, date i, event_count l, avg_goldstein d",
    "gkg_themes_continent": "theme s, continent s, year s, mention_count l, rank i",
    "top_organizations": "organization s, date s, mention_count l, rank i",
    "tone_conflict_lag":
        "country s, date i, today_avg_tone d, today_conflict_count l, tomorrow_conflict_count l",
    "diplomatic_network":
        "source_country s, target_country s, diplomatic_count l, conflict_count l, total_interactions l",
    "source_diversity_index": "country s, date i, unique_sources l, total_mentions l, source_diversity_index d",
    "ethnic_conflicts": "ethnicity s, date i, event_count l, avg_goldstein d",
    "breaking_news": "GlobalEventID l, first_mention_time t, mentions_in_first_hour l, country s, date i",
    "extreme_tone_events":
        "GlobalEventID l, country s, ActionGeo_FullName s, EventRootCode s, QuadClass i, AvgTone d, NumMentions i, "
        "Day i, tone_extreme_type s",
    "top_article_coverage": "country s, total_articles l, avg_articles_per_event d, event_count l",
}


@pytest.mark.parametrize("name", list(ANALYSES))
def test_result_schema(tables, name):
    short = {"string": "s", "int": "i", "bigint": "l", "double": "d", "timestamp": "t"}
    got = ", ".join(f"{column} {short[kind]}" for column, kind in ANALYSES[name].run(tables).dtypes)
    assert got == RESULT_SCHEMAS[name]


def test_streaming_commands(spark, tables, tmp_path, now, monkeypatch):
    monkeypatch.setattr("wirepulse.session.create_session", lambda *_: spark)
    places = ["--tables", str(tmp_path / "in"), "--out", str(tmp_path / "out"), "--checkpoint", str(tmp_path / "ck")]
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "1.mentions.csv").write_text("1\t\t20240101000000\n1\t\t20240101050000\n" * 3)
    assert main(["stream", "ingest", "--raw", str(tmp_path / "raw"), *places, "--once"]) == 0
    assert main(["stream", "escalation", *places, "--once"]) == 0
    found = spark.read.parquet(str(tmp_path / "out" / "escalation_events"))
    assert rows_of(found, "GlobalEventID", "mentions_this_hour") == [(1, 3)]
    with pytest.raises(SystemExit):
        build_parser().parse_args(["stream", "other", "--checkpoint", "x"])


def test_command_line(spark, tables, tmp_path, now, monkeypatch):
    monkeypatch.setattr("wirepulse.session.create_session", lambda *_: spark)
    for name, df in tables.items():
        landed.land(df, name, str(tmp_path / "in"), now)
    args = ["run", "--group", "media", "--in", str(tmp_path / "in"), "--out", str(tmp_path / "out"),
            "--since", "2024-03-05T00:00:00"]
    assert main(args) == 0
    assert results.read_result(spark, str(tmp_path / "out"), "top_organizations").count() == 2
    assert main(["expire", "--out", str(tmp_path / "in"), "--retention-hours", "1"]) == 0
    assert landed.read_events(spark, str(tmp_path / "in")).count() == 0
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "1.gkg.csv").write_text("g1\t20240101000000\n")
    assert main(["ingest", "--raw", str(tmp_path / "raw"), "--out", str(tmp_path / "in")]) == 0
    assert landed.read_gkg(spark, str(tmp_path / "in")).count() == 1
    with pytest.raises(SystemExit):
        build_parser().parse_args(["run", "--group", "none", "--out", "x"])


def test_a_group_reads_only_its_tables_and_failures_are_logged(spark, tmp_path, tables, now):
    landed.land(tables["events"], "events", str(tmp_path / "in"), now)
    landed.land(tables["mentions"], "mentions", str(tmp_path / "in"), now)
    assert batch.run_group(spark, str(tmp_path / "in"), str(tmp_path / "out"), "conflicts")
    with pytest.raises(Exception, match="gkg"):
        batch.run_group(spark, str(tmp_path / "in"), str(tmp_path / "out"), "media")
    assert [row["status"] for row in results.run_log(spark, str(tmp_path / "out")).collect()] == ["failed", "success"]


def test_next_day_lag_skips_dates_that_are_no_day(events_of):
    days = ("20240229", "20240230", "20240301")
    events = events_of(*[
        {"GlobalEventID": k, "DATEADDED": f"{day}000000", "AvgTone": 1.0, "QuadClass": 4} for k, day in enumerate(days)
    ])
    got = {row["date"]: row["tomorrow_conflict_count"] for row in sentiment.tone_conflict_lag(events).collect()}
    assert got == {20240229: 1, 20240230: None, 20240301: None}
