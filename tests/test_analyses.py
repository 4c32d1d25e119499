"""Toy rows for the cases that the large tables do not hold."""

from __future__ import annotations

import math
from datetime import datetime

import pytest

from tests.conftest import F, rows_of
from wirepulse.functions.columns import stamp_number, wall_clock
from wirepulse.functions import lookups
from wirepulse.operators import actors, conflict, media, ranking, sentiment


def test_heatmap_keeps_conflict_and_known_countries(events_of):
    events = events_of(
        {"QuadClass": 3, "GoldsteinScale": -4.0, "NumMentions": 2},
        {"QuadClass": 4, "GoldsteinScale": -6.0, "NumMentions": 4},
        {"QuadClass": 2, "GoldsteinScale": 9.0, "NumMentions": 9},
        {"QuadClass": None, "GoldsteinScale": 9.0},
        {"QuadClass": 4, "GoldsteinScale": 1.0, "ActionGeo_CountryCode": None},
    )
    assert rows_of(conflict.conflict_heatmap(events)) == [("FR", 20240229, -5.0, 2, 3.0)]


def test_heatmap_groups_unreadable_publication_dates(events_of):
    events = events_of({"QuadClass": 3, "DATEADDED": "soon", "GoldsteinScale": 1.0})
    assert rows_of(conflict.conflict_heatmap(events), "country", "date", "event_count") == [("FR", None, 1)]


def test_publication_and_event_dates_are_kept_apart(events_of):
    events = events_of({"QuadClass": 3, "Day": 20240101, "DATEADDED": "20240302000000", "NumMentions": 4})
    assert rows_of(conflict.conflict_heatmap(events), "date") == [(20240302,)]
    assert rows_of(media.media_coverage_ratio(events)) == [("FR", 20240101, 4, 1, 4.0)]


def test_correlation_of_degenerate_groups(events_of):
    def event(country, tone, sources):
        return {"ActionGeo_CountryCode": country, "AvgTone": tone, "NumSources": sources}

    events = events_of(
        event("AA", 1.0, 1),
        event("BB", 2.0, 1), event("BB", 2.0, 5),
        event("CC", 1.0, 2), event("CC", 2.0, 4), event("CC", 3.0, 6),
        event("DD", None, 4),
    )
    found = dict(rows_of(sentiment.tone_source_correlation(events), "country", "tone_sources_correlation"))
    assert set(found) == {"AA", "BB", "CC"}
    assert found["AA"] is None and found["BB"] is None
    assert found["CC"] == pytest.approx(1.0)


def test_rank_keeps_all_ties(events_of, gkg_of):
    events = events_of(*[{"ActionGeo_CountryCode": f"C{i:02}"} for i in range(11)])
    assert {r[3] for r in rows_of(media.top_news_countries(events))} == {1}
    assert media.top_news_countries(events).count() == 11
    orgs = ";".join(f"org{i}" for i in range(25))
    assert media.top_organizations(gkg_of({"DATE": "20240101000000", "Organizations": orgs})).count() == 25


def test_ranking_equals_rank_window(spark):
    from pyspark.sql import Window

    counted = spark.range(4000).select(
        F.when(F.col("id") % 7 > 0, F.col("id") % 7).alias("date"),
        (F.hash("id") % 40).cast("long").alias("n"),
        F.col("id"),
    )
    window = Window.partitionBy("date").orderBy(F.desc("n"))
    expected = counted.withColumn("rank", F.rank().over(window)).where("rank <= 12")
    got = ranking.keep_top_ranked(counted, ["date"], "n", 12)
    assert rows_of(got, "date", "n", "id", "rank") == rows_of(expected, "date", "n", "id", "rank")


def test_regions_and_labels(events_of):
    events = events_of(
        {"ActionGeo_CountryCode": "RS", "EventRootCode": "14"},
        {"ActionGeo_CountryCode": "ZZ", "EventRootCode": "99"},
        {"ActionGeo_CountryCode": None, "EventRootCode": "14"},
        {"EventRootCode": None},
    )
    assert rows_of(actors.cameo_distribution(events)) == [
        ("14", "Protestas", "Europe/Asia", 20240229, 1),
        ("99", None, "Other", 20240229, 1),
    ]


def test_own_region_table(spark, events_of):
    regions = spark.createDataFrame([("FR", "Mine")], ["code", "place"])
    events = events_of({"EventRootCode": "01"})
    assert rows_of(actors.cameo_distribution(events, regions=regions), "region") == [("Mine",)]


def test_religion_falls_back_and_drops_blank(events_of):
    events = events_of(
        {"QuadClass": 3, "Actor1Religion1Code": None, "Actor2Religion1Code": "MOS", "GoldsteinScale": -2.0},
        {"QuadClass": 3, "Actor1Religion1Code": "", "Actor2Religion1Code": "MOS"},
        {"QuadClass": 4, "Actor1Religion1Code": "CHR", "ActionGeo_CountryCode": None, "GoldsteinScale": -8.0},
        {"QuadClass": 2, "Actor1Religion1Code": "CHR"},
    )
    assert rows_of(actors.religion_conflict_cluster(events)) == [
        ("CHR", "Other", 20240229, 1, -8.0),
        ("MOS", "Europe", 20240229, 1, -2.0),
    ]


def test_actor_matrix_needs_both_types(events_of):
    events = events_of(
        {"Actor1Type1Code": "GOV", "Actor2Type1Code": "MIL", "GoldsteinScale": 2.0, "AvgTone": 1.0},
        {"Actor1Type1Code": "GOV", "Actor2Type1Code": "MIL", "GoldsteinScale": 4.0, "AvgTone": 2.0},
        {"Actor1Type1Code": "GOV"},
    )
    assert rows_of(actors.actor_interaction_matrix(events)) == [("GOV", "MIL", 2, 3.0, 1.5)]


def test_trend_averages_observed_days(events_of):
    days = [("20240101", 1.0), ("20240103", 2.0), ("20240110", 6.0), ("20240111", 8.0)]
    events = events_of(*[{"DATEADDED": d + "000000", "AvgTone": t} for d, t in days])
    assert [r[3] for r in rows_of(sentiment.sentiment_trend(events))] == [1.0, 1.5, 3.0, pytest.approx(16 / 3)]


def test_lag_crosses_the_month_end_and_skips_gaps(events_of):
    events = events_of(
        {"DATEADDED": "20240229000000", "QuadClass": 1, "AvgTone": 1.0},
        {"DATEADDED": "20240301000000", "QuadClass": 4},
        {"DATEADDED": "20240303000000", "QuadClass": 4},
        {"DATEADDED": "bad"},
    )
    assert rows_of(sentiment.tone_conflict_lag(events), "date", "today_conflict_count", "tomorrow_conflict_count") == [
        (None, 0, None), (20240229, 0, 1), (20240301, 1, None), (20240303, 1, None),
    ]


def test_pairs_and_network_are_directed(events_of):
    def event(source, target, quad):
        return {"Actor1CountryCode": source, "Actor2CountryCode": target, "QuadClass": quad, "GoldsteinScale": -1.0}

    events = events_of(
        event("A", "B", 1), event("A", "B", 4), event("B", "A", 3), event("A", "A", 3),
        event("A", "B", None), event(None, "B", 3),
    )
    assert rows_of(conflict.diplomatic_network(events)) == [("A", "B", 1, 1, 3), ("B", "A", 0, 1, 1)]
    assert rows_of(conflict.conflict_pairs(events)) == [("A", "B", 20240229, 1, -1.0), ("B", "A", 20240229, 1, -1.0)]


def test_ethnic_mean_of_role_means(events_of):
    events = events_of(
        {"QuadClass": 3, "Actor1EthnicCode": "kur", "GoldsteinScale": -10.0},
        {"QuadClass": 3, "Actor1EthnicCode": "kur", "GoldsteinScale": -10.0, "Actor2EthnicCode": ""},
        {"QuadClass": 4, "Actor2EthnicCode": "kur", "GoldsteinScale": 0.0},
        {"QuadClass": 1, "Actor2EthnicCode": "kur", "GoldsteinScale": 9.0},
    )
    assert rows_of(conflict.ethnic_conflicts(events)) == [("kur", 20240229, 3, -5.0)]
    ((_, _, count, mean),) = rows_of(conflict.ethnic_conflicts(events, weighted=True))
    assert (count, mean) == (3, pytest.approx(-20 / 3))


def test_ethnic_group_in_both_roles_counts_twice(events_of):
    events = events_of({"QuadClass": 3, "Actor1EthnicCode": "x", "Actor2EthnicCode": "x", "GoldsteinScale": -4.0})
    assert rows_of(conflict.ethnic_conflicts(events)) == [("x", 20240229, 2, -4.0)]


def test_escalation_ratio_and_frames(mentions_of):
    first = [(3, "20240101000500")] * 5
    later = [(3, "20240105040500")] * 5
    mentions = mentions_of((1, "20240101000000"), (2, "20240101000000"), (2, "20240101005959"), *first, *later)
    got = rows_of(conflict.escalation_events(mentions), "GlobalEventID", "mentions_last_24h", "escalation_ratio")
    assert got == [(2, 2, pytest.approx(2 / 3)), (3, 5, pytest.approx(5 / 6))]
    by_clock = rows_of(conflict.escalation_events(mentions, frame="range"), "GlobalEventID", "mentions_last_24h")
    assert by_clock == [(2, 2), (3, 5), (3, 5)]
    with pytest.raises(ValueError):
        conflict.escalation_events(mentions, frame="days")


def test_escalation_counts_unreadable_times_under_no_hour(mentions_of):
    bad = ("bad", "bad", None, "20240230100000", "20240230110000", "20240101249999", "20240101250000", "20240101006000")
    mentions = mentions_of(*[(1, text) for text in bad])
    assert rows_of(conflict.escalation_events(mentions), "mention_hour", "mentions_this_hour") == [(None, 8)]


def test_breaking_news_threshold_and_inclusive_hour(events_of, mentions_of):
    mentions = mentions_of(
        *[(1, "20240101000000")] * 99,
        *[(2, "20240101000000")] * 99, (2, "20240101010000"), (2, "20240101010001"),
        *[(3, "20240101000000")] * 100, (3, "bad"),
        *[(None, "20240101000000")] * 100,
    )
    events = events_of({"GlobalEventID": 2, "ActionGeo_CountryCode": "US", "Day": 20240101})
    start = datetime(2024, 1, 1)
    assert rows_of(media.breaking_news(mentions, events)) == [
        (2, start, 100, "US", 20240101), (3, start, 100, None, None),
    ]
    assert media.breaking_news(mentions, events, threshold=99).count() == 3


def test_source_diversity_counts_every_mention(events_of, mentions_of):
    mentions = mentions_of((1, "x", "a"), (1, "x", "a"), (1, "x", "b"), (2, "x", "a"), (1, "x", None), (9, "x", "a"))
    events = events_of({"GlobalEventID": 1}, {"GlobalEventID": 2}, {"GlobalEventID": 3})
    assert rows_of(media.source_diversity_index(mentions, events)) == [
        ("FR", 20240229, 2, 4, pytest.approx(math.log(3))),
    ]
    assert rows_of(media.source_diversity_index(mentions, events, approx=True), "unique_sources") == [(2,)]


def test_repeated_event_ids_multiply_mentions(events_of, mentions_of):
    events = events_of({"GlobalEventID": 1}, {"GlobalEventID": 1})
    assert rows_of(media.source_diversity_index(mentions_of((1, "x", "a")), events), "total_mentions") == [(2,)]


def test_themes_cut_and_located(gkg_of):
    def record(themes, places):
        return {"DATE": "20240101000000", "V2Themes": themes, "V2Locations": places}

    gkg = gkg_of(
        record("TAX,12;ARMED#3,4;", "1#Paris#FR#A#1#2#3"),
        record("TAX,9", None),
        record("TAX,9", "nothing here"),
        record("", "1#Paris#FR#A#1#2#3"),
        record(None, None),
    )
    assert rows_of(sentiment.gkg_themes_continent(gkg)) == [
        ("ARMED", "Europe", "2024", 1, 1), ("TAX", "Europe", "2024", 1, 1), ("TAX", "Unknown", "2024", 2, 1),
    ]


def test_organizations_are_trimmed(gkg_of):
    gkg = gkg_of(
        {"DATE": "20240101000000", "Organizations": "nato; nato ;;un"},
        {"DATE": "20240101120000", "Organizations": ""},
    )
    assert rows_of(media.top_organizations(gkg)) == [("nato", "20240101", 2, 1), ("un", "20240101", 1, 2)]


def test_extremes_break_ties_by_id(events_of):
    events = events_of(*[{"AvgTone": 1.0} for _ in range(40)], {"AvgTone": None})
    got = rows_of(sentiment.extreme_tone_events(events, n=3), "GlobalEventID", "tone_extreme_type")
    assert got == sorted([(i, side) for i in range(3) for side in ("most_negative", "most_positive")])


def test_articles_skip_missing_counts(events_of):
    events = events_of(
        {"NumArticles": 3}, {"NumArticles": 5}, {"NumArticles": None},
        {"NumArticles": None, "ActionGeo_CountryCode": "US"},
    )
    assert rows_of(media.top_article_coverage(events)) == [("FR", 8, 4.0, 2)]


@pytest.mark.parametrize("text, expected", [
    ("20240229123456", datetime(2024, 2, 29, 12, 34, 56)),
    ("20240230123456", None), ("20240101240000", None), ("20240101000060", None), ("20240101", None),
    ("2024-01-01 0000", None), ("2024010112345 ", None), (" 2024010112345", None), ("00240101123456", None),
    ("20241301000000", None), ("20240101006000", None), ("202401010000000", None), ("", None), (None, None), ("abcdefghijklmn", None),
])
def test_wall_clock(spark, text, expected):
    df = spark.createDataFrame([(text,)], "stamp string").select(wall_clock(stamp_number("stamp")).alias("at"))
    assert df.first()["at"] == expected


@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Kolkata"])
def test_hours_do_not_depend_on_the_session_zone(spark, mentions_of, zone):
    mentions = mentions_of(*[(1, "20240310023000")] * 2)
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        hours = conflict.hourly_mentions(mentions).select(F.col("mention_hour").cast("string")).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert [r[0] for r in hours] == ["2024-03-10 02:00:00"]


def test_code_table_keeps_any_text(spark):
    entries = {"a'b": "it's \\ \"x\"", "c": "é"}
    assert dict(rows_of(lookups.code_table(spark, entries, "code", "label"))) == entries


def test_invariants(spark, events_of):
    events = events_of(*[
        {"QuadClass": 1 + i % 4, "EventRootCode": f"{1 + i % 20:02}", "AvgTone": float(i % 13),
         "ActionGeo_CountryCode": ["US", "FR", "ZZ", None][i % 4],
         "Actor1CountryCode": "AB"[i % 2], "Actor2CountryCode": "BC"[i % 2]}
        for i in range(200)
    ])
    assert actors.cameo_distribution(events).agg(F.sum("event_count")).first()[0] == 150
    network = conflict.diplomatic_network(events)
    assert network.where("diplomatic_count + conflict_count > total_interactions").count() == 0
    assert sentiment.extreme_tone_events(events).count() == 30
    assert media.top_news_countries(events, k=2).where("rank > 2").count() == 0


def test_merged_sketches_of_sources_are_near(spark, mentions_of, events_of):
    mentions = mentions_of(*[(i % 40, "20240101000000", f"s{(i * 7919) % 9000}") for i in range(12_000)])
    events = events_of(*[{"GlobalEventID": i, "Day": 20240101 + i % 8, "ActionGeo_CountryCode": "FR"} for i in range(40)])
    daily = media.source_sketches(mentions, events)
    assert daily.count() == 8
    (row,) = media.diversity_over_days(daily).collect()
    assert row["total_mentions"] == 12_000
    assert abs(row["unique_sources"] - 9000) <= 0.03 * 9000
