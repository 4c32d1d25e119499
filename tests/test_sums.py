"""Results merged from stored sums equal the batch analyses over all rows."""

from __future__ import annotations

import random

import pytest

from tests.conftest import plan_of, rows_of, table
from wirepulse.plans.registry import ANALYSES
from wirepulse.plans.results import read_result
from wirepulse.schema import landed_schema
from wirepulse.sources import landed
from wirepulse.streaming import sums


def made_events(spark, count=260, seed=1):
    rng = random.Random(seed)
    pick = rng.choice
    return [
        {
            "GlobalEventID": pick([i, None]) if i % 20 == 0 else i, "Day": pick([20240229, 20240301, 20240302, 20240305, None]),
            "DATEADDED": pick(["20240228", "20240229", "20240301", "20240304", "20240310", "x", None]),
            "ActionGeo_CountryCode": pick(["FR", "US", "ZZ", None]), "QuadClass": pick([1, 2, 3, 4, None]),
            "GoldsteinScale": pick([None, -7.3, 0.1, 2.25]), "AvgTone": pick([None, 0.1, -3.7, 8.0]), "NumMentions": pick([None, 1, 5]),
            "NumSources": pick([None, 2, 3, 9]), "NumArticles": pick([None, 0, 4]), "EventRootCode": pick(["01", "19", "77", None]),
            "Actor1CountryCode": pick(["FR", "US", None]), "Actor2CountryCode": pick(["FR", "DE", None]),
            "Actor1EthnicCode": pick(["x", "", None]), "Actor2EthnicCode": pick(["x", "y", None]),
            "Actor1Religion1Code": pick(["r", "", None]), "Actor2Religion1Code": pick(["r", "q", None]),
            "Actor1Type1Code": pick(["GOV", "MIL", None]), "Actor2Type1Code": pick(["GOV", None]),
        }
        for i in range(count)
    ]


def made(spark):
    mentions = [
        {"GlobalEventID": i % 4 or None, "MentionTimeDate": ["20240101%02d0000" % (0 if i % 5 < 4 else 3), "bad"][i % 31 == 0], "MentionSourceName": [f"s{i % 6}", None][i % 17 == 0]}
        for i in range(900)
    ]
    gkg = [
        {"DATE": f"2024010{1 + i % 3}000000", "V2Themes": f"T{i % 4},1;T{i % 3}#2;;", "V2Locations": [f"1#P#{['FR', 'ZZ'][i % 2]}#", None][i % 7 == 0],
         "Organizations": ["a; b;;c", None, "a"][i % 3]} for i in range(60)
    ]
    return {"events": made_events(spark), "mentions": mentions, "gkg": gkg}


def approximately(got, expected):
    assert len(got) == len(expected) > 0
    for one, other in zip(got, expected, strict=True):
        for a, b in zip(one, other, strict=True):
            assert a == (pytest.approx(b, abs=1e-9) if isinstance(b, float) else b)


#: One result of each way to add up or to choose days; the registered queries merge all of them.
SOME = (
    "tone_source_correlation", "sentiment_trend", "tone_conflict_lag", "conflict_pairs", "extreme_tone_events", "gkg_themes_continent",
    "breaking_news",
)


def test_results_after_merges_with_repeats_and_folds(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sums, "FOLD_AFTER", 2)
    rows = made(spark)
    whole = {name: table(spark, name, held) for name, held in rows.items()}
    store, out = sums.Store(spark, str(tmp_path / "sums")), str(tmp_path / "out")
    for number in (1, 2, 3, 3):
        parts = {name: table(spark, name, held[number - 1::3]) for name, held in rows.items()}
        sums.merge_batch(parts, number, store, out, list(SOME))
    folds = sorted(path.name for path in (tmp_path / "sums" / "country_day").iterdir())
    assert folds == ["b0000000003", "f0000000003"]
    for name in SOME:
        expected = ANALYSES[name].run(whole)
        got = read_result(spark, out, name)
        assert got.columns == expected.columns
        approximately(rows_of(got), rows_of(expected))


def test_co_moments_of_constant_and_single_values(spark):
    def event(i, tone, sources, country):
        return {"GlobalEventID": i, "DATEADDED": "20240101", "ActionGeo_CountryCode": country, "AvgTone": tone, "NumSources": sources}

    rows = [event(i, 0.1, i % 3, "constant") for i in range(9)] + [event(10, 1.0, 2, "single")]
    rows += [event(20 + i, 1e6 + i * 0.001, 5 - i, "line") for i in range(5)] + [event(30, None, 3, "none")]
    parts = [sums.country_day_sums(table(spark, "events", rows[k::3])) for k in range(3)]
    added = sums.add_country_days(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    got = {r["country"]: r["tone_sources"] for r in sums.country_day_from(added).collect()}
    assert got["constant"] is None and got["single"] is None and got["none"] is None
    assert got["line"] == pytest.approx(-1.0, abs=1e-6)


def test_days_that_depend_on_touched_days(spark):
    days = spark.createDataFrame(
        [("FR", d) for d in (20240228, 20240301, 20240302, 20240309)] + [("US", 20240303)], "country string, date int"
    )
    touched = spark.createDataFrame([("FR", 20240301)], "country string, date int")
    assert rows_of(sums.trend_days(days, touched)) == [(20240301,), (20240302,), (20240309,)]
    assert rows_of(sums.lag_days(days, touched)) == [(20240229,), (20240301,)]


def test_only_touched_days_are_replaced_and_no_history_is_read(spark, tmp_path, monkeypatch):
    def event(i, day):
        return {"GlobalEventID": i, "DATEADDED": day, "ActionGeo_CountryCode": "FR", "QuadClass": 3, "AvgTone": 1.0 * i}

    store, out = sums.Store(spark, str(tmp_path / "sums")), str(tmp_path / "out")
    names = ["conflict_heatmap", "tone_conflict_lag"]
    sums.merge_batch({"events": table(spark, "events", [event(1, "20240101"), event(2, "20240105"), event(3, "20240229")])}, 1, store, out, names)
    place = {day: next((tmp_path / "out" / name / f"date={day}").glob("*.parquet")) for name in names[:1] for day in (20240101, 20240105)}
    reads, read = [], sums.Store._read
    monkeypatch.setattr(sums.Store, "_read", lambda self, *a: reads.append(read(self, *a)) or reads[-1])
    sums.merge_batch({"events": table(spark, "events", [event(4, "20240301")])}, 2, store, out, names)
    assert all("/sums/" in path for rows in reads for path in rows.inputFiles())
    assert all(path.exists() for path in place.values())
    assert rows_of(read_result(spark, out, names[0]), "date", "event_count") == [(20240101, 1), (20240105, 1), (20240229, 1), (20240301, 1)]
    assert rows_of(read_result(spark, out, names[1]), "date", "tomorrow_conflict_count")[2:] == [(20240229, 1), (20240301, None)]
    pruned = store.read("country_day", sums._of_days("date", spark.createDataFrame([(20240301,)], "_day int")))
    assert "PartitionFilters: [" in plan_of(pruned) and "20240301" in plan_of(pruned).split("PartitionFilters: [", 1)[1].split("]", 1)[0]


def test_stream_of_three_tables_with_history(spark, tmp_path, now):
    rows = made(spark)
    store, out = str(tmp_path / "store"), str(tmp_path / "out")
    older = {name: table(spark, name, held[::2]) for name, held in rows.items()}

    def arrivals():
        return {name: spark.readStream.schema(landed_schema(name)).parquet(f"{store}/{name}") for name in rows}

    for turn in (1, 3):
        for name, held in rows.items():
            landed.land(table(spark, name, held[turn::4]), name, store, now)
        sums.merge_results_stream(arrivals(), out, str(tmp_path / "ck"), ["breaking_news", "top_organizations", "sentiment_trend"], history=lambda: older, once=True).awaitTermination()
    whole = {name: table(spark, name, held) for name, held in rows.items()}
    for name in ("breaking_news", "top_organizations", "sentiment_trend"):
        approximately(rows_of(read_result(spark, out, name)), rows_of(ANALYSES[name].run(whole)))
