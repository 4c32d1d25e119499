"""Streams give what the batch analyses give on closed time."""

from __future__ import annotations

import json
import os
import shutil
import time
from datetime import datetime

import pytest
from pyspark.errors import StreamingQueryException

from tests.conftest import F, rows_of, table
from wirepulse.operators import conflict, media
from wirepulse.schema import landed_schema, raw_schema
from wirepulse.sources import landed
from wirepulse.streaming import detectors, refresh
from wirepulse.streaming.ingest import ingest_stream


def event_line(event_id, day="20240101"):
    values = {"GlobalEventID": str(event_id), "Day": day}
    return "\t".join(values.get(c, "") for c in raw_schema("events").names)


def drop(folder, name, *lines):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(text + "\n" for text in lines))


def ingest_once(spark, tmp_path, **settings):
    ingest_stream(
        spark, str(tmp_path / "raw"), str(tmp_path / "out"), str(tmp_path / "ck"), once=True, **settings,
    ).awaitTermination()


def test_ingest_drops_repeats_across_files_and_runs(spark, tmp_path):
    drop(tmp_path / "raw", "1.export.CSV", *[event_line(i) for i in (1, 1, 2)], event_line("?"), event_line("?"))
    drop(tmp_path / "raw", "2.export.CSV", event_line(2), event_line(3))
    ingest_once(spark, tmp_path, max_files=1)
    drop(tmp_path / "raw", "3.export.CSV", event_line(3), event_line(4))
    drop(tmp_path / "raw", "3.gkg.csv", "not an event")
    ingest_once(spark, tmp_path)
    got = spark.read.schema(landed_schema("events")).parquet(str(tmp_path / "out" / "events"))
    assert rows_of(got, "GlobalEventID") == [(None,), (None,), (1,), (2,), (3,), (4,)]
    assert got.where("ingest_date IS NULL OR ingest_hour NOT BETWEEN 0 AND 23").count() == 0
    assert rows_of(landed.read_events(spark, str(tmp_path / "out")), "GlobalEventID") == rows_of(got, "GlobalEventID")


def test_ingest_without_salting(spark, tmp_path):
    drop(tmp_path / "raw", "1.export.CSV", *[event_line(i % 3) for i in range(9)])
    ingest_once(spark, tmp_path, salts=1, retention_hours=1)
    assert landed.read_events(spark, str(tmp_path / "out")).count() == 3


def test_a_new_checkpoint_at_the_old_place_lands_on(spark, tmp_path):
    drop(tmp_path / "raw", "1.export.CSV", event_line(1))
    ingest_once(spark, tmp_path)
    shutil.move(tmp_path / "ck", tmp_path / "gone")
    drop(tmp_path / "raw", "2.export.CSV", event_line(2))
    ingest_once(spark, tmp_path)
    # The new stream begins at the beginning, and none of its batches counts as landed.
    assert rows_of(landed.read_events(spark, str(tmp_path / "out")), "GlobalEventID") == [(1,), (1,), (2,)]


def test_a_batch_landed_before_is_not_landed_again(spark, tmp_path, monkeypatch):
    from wirepulse.streaming import ingest as module

    def fails(*_):
        raise RuntimeError("lost after landing")

    drop(tmp_path / "raw", "1.export.CSV", event_line(1))
    with monkeypatch.context() as patch:
        patch.setattr(module, "expire", fails)
        with pytest.raises(StreamingQueryException):
            ingest_once(spark, tmp_path, retention_hours=1)
    assert landed.read_events(spark, str(tmp_path / "out")).count() == 1
    ingest_once(spark, tmp_path, retention_hours=1)
    assert landed.read_events(spark, str(tmp_path / "out")).count() == 1


def test_old_event_dates_are_not_late(spark, tmp_path):
    drop(tmp_path / "raw", "1.export.CSV", event_line(1, "20240101"))
    ingest_once(spark, tmp_path)
    drop(tmp_path / "raw", "2.export.CSV", event_line(2, "19990101"))
    ingest_once(spark, tmp_path)
    assert landed.read_events(spark, str(tmp_path / "out")).count() == 2


def mention_stream(spark, tmp_path, batches):
    """One file per batch, read one at a time in the order of their modification times."""
    folder = tmp_path / "mentions"
    folder.mkdir()
    start = time.time() - 1000
    for number, rows in enumerate(batches):
        path = folder / f"{number}.json"
        path.write_text("".join(json.dumps({"GlobalEventID": i, "MentionTimeDate": t}) + "\n" for i, t in rows))
        os.utime(path, (start + 10 * number,) * 2)
    return (
        spark.readStream.schema("GlobalEventID long, MentionTimeDate string")
        .option("maxFilesPerTrigger", 1).json(str(folder))
    )


def stamp(hour, minute=0, second=0, day=1):
    return f"202401{day:02}{hour:02}{minute:02}{second:02}"


def test_escalation_over_several_batches_equals_batch(spark, tmp_path, mentions_of):
    batches = [
        [(1, stamp(0))] * 2 + [(2, stamp(0, 10))] * 4,
        [(1, stamp(2, 5))] * 6 + [(3, stamp(2))],
        [(1, stamp(5))] * 30 + [(2, stamp(5))],
        [(9, stamp(12))],
    ]
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    for query in detectors.run_escalation(spark, mention_stream(spark, tmp_path, batches), out, ck, once=True):
        query.awaitTermination()
    got = spark.read.schema(detectors.ESCALATION_SCHEMA).parquet(f"{out}/escalation_events")
    expected = conflict.escalation_events(mentions_of(*[row for batch in batches for row in batch]))
    columns = ("GlobalEventID", "mention_hour", "mentions_last_24h", "mentions_this_hour", "escalation_ratio")
    assert rows_of(got, *columns) == rows_of(expected, *columns)
    assert got.count() == 4


def test_breaking_over_several_batches_equals_batch(spark, tmp_path, mentions_of):
    batches = [
        [(1, stamp(0))] * 3 + [(2, stamp(0, 30))] * 2,
        [(1, stamp(1))] * 2 + [(1, stamp(1, 0, 1))] * 9 + [(2, stamp(1, 20))],
        [(3, stamp(4))] * 5 + [(2, stamp(4))] * 9,
        [(9, stamp(12))],
        [(9, stamp(20))] * 9,
    ]
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    stream = mention_stream(spark, tmp_path, batches)
    for query in detectors.run_breaking(spark, stream, out, ck, once=True, threshold=5):
        query.awaitTermination()
    got = spark.read.schema(detectors.BURST_SCHEMA).parquet(f"{out}/breaking_bursts")
    mentions = mentions_of(*[row for batch in batches for row in batch])
    expected = media.first_hour_bursts(mentions, threshold=5)
    assert rows_of(got) == rows_of(expected) == [(1, datetime(2024, 1, 1), 5), (3, datetime(2024, 1, 1, 4), 5)]


def test_mention_counts_of_closed_hours(spark, tmp_path):
    stream = mention_stream(spark, tmp_path, [
        [(1, stamp(0, 59, 59)), (1, stamp(0)), (1, stamp(1)), (2, "bad"), (None, stamp(0))], [(1, stamp(3))],
    ])
    counts = detectors.mention_counts_stream(stream)
    detectors.write_stream(counts, "hourly", str(tmp_path / "out"), str(tmp_path / "ck"), once=True).awaitTermination()
    got = spark.read.schema(detectors.COUNTS_SCHEMA).parquet(str(tmp_path / "out" / "hourly"))
    assert rows_of(got) == [
        (None, datetime(2024, 1, 1), 1), (1, datetime(2024, 1, 1), 2), (1, datetime(2024, 1, 1, 1), 1),
    ]


def test_refresh_replaces_only_touched_days(spark, tmp_path, now):
    def event(i, day, country="FR"):
        return {"GlobalEventID": i, "Day": day, "DATEADDED": f"{day}000000", "ActionGeo_CountryCode": country,
                "QuadClass": 3, "GoldsteinScale": -float(i), "EventRootCode": "01"}

    store, out, ck = str(tmp_path / "store"), str(tmp_path / "out"), str(tmp_path / "ck")

    def cycle(*rows):
        landed.land(table(spark, "events", list(rows)), "events", store, now)
        arrivals = spark.readStream.schema(landed_schema("events")).parquet(f"{store}/events")
        refresh.refresh_results_stream(
            lambda: landed.read_events(spark, store), arrivals, out, ck, once=True,
        ).awaitTermination()
        return spark.read.parquet(f"{out}/conflict_heatmap")

    first = cycle(event(1, 20240101), event(2, 20240102), {**event(7, 20240101), "DATEADDED": None})
    assert rows_of(first, "date", "event_count") == [(None, 1), (20240101, 1), (20240102, 1)]
    untouched = first.where("date = 20240101").select(F.input_file_name()).first()[0]
    second = cycle(event(3, 20240102), event(4, 20240103))
    assert rows_of(second, "date", "event_count") == [(None, 1), (20240101, 1), (20240102, 2), (20240103, 1)]
    assert second.where("date = 20240101").select(F.input_file_name()).first()[0] == untouched
    direct = conflict.conflict_heatmap(landed.read_events(spark, store))
    assert rows_of(second, "date", "event_count", "avg_goldstein") == rows_of(
        direct, "date", "event_count", "avg_goldstein"
    )
    names = {a.result for a in refresh.daily_analyses()}
    assert "cameo_distribution" in names and "sentiment_trend" not in names
    assert all((tmp_path / "out" / name).exists() for name in names)


def test_refresh_reads_the_history_anew_for_each_batch(spark, tmp_path, now):
    store, out = str(tmp_path / "store"), str(tmp_path / "out")
    for i in (1, 2):
        row = {"GlobalEventID": i, "Day": 20240101, "DATEADDED": "20240101000000", "ActionGeo_CountryCode": "FR"}
        landed.land(table(spark, "events", [row]), "events", store, now)
    arrivals = (
        spark.readStream.schema(landed_schema("events")).option("maxFilesPerTrigger", 1).parquet(f"{store}/events")
    )
    reads = []

    def history():
        reads.append(1)
        return landed.read_events(spark, store)

    refresh.refresh_results_stream(
        history, arrivals, out, str(tmp_path / "ck"), ["media_coverage_ratio"], once=True,
    ).awaitTermination()
    assert len(reads) >= 2
    assert rows_of(spark.read.parquet(f"{out}/media_coverage_ratio"), "total_events") == [(2,)]


def test_both_stages_run_continuously_from_an_empty_start(spark, tmp_path):
    stream = mention_stream(spark, tmp_path, [[(1, stamp(0))] * 3, [(1, stamp(9))]])
    out, ck = str(tmp_path / "not" / "there"), str(tmp_path / "ck")
    queries = detectors.run_breaking(spark, stream, out, ck) + detectors.run_escalation(spark, stream, out, ck)
    try:
        deadline = time.time() + 60
        while any(query.lastProgress is None for query in queries[::2]) and time.time() < deadline:
            time.sleep(1)
        assert all(query.isActive and query.exception() is None for query in queries)
    finally:
        for query in queries:
            query.stop()


@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Kolkata"])
def test_bursts_do_not_depend_on_the_session_zone(spark, tmp_path, mentions_of, zone):
    batches = [[(1, stamp(0))] * 3, [(1, stamp(0, 59))] * 2 + [(2, stamp(3))] * 5, [(9, stamp(12))], [(9, stamp(20))] * 9]
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
        for query in detectors.run_breaking(spark, mention_stream(spark, tmp_path, batches), out, ck, once=True, threshold=5):
            query.awaitTermination()
        got = spark.read.schema(detectors.BURST_SCHEMA).parquet(f"{out}/breaking_bursts")
        texts = got.select("GlobalEventID", F.date_format("first_mention_time", "yyyyMMddHHmmss").alias("at"), "mentions_in_first_hour")
        assert rows_of(texts) == [(1, stamp(0), 5), (2, stamp(3), 5)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_escalation_forgets_silent_events(spark, tmp_path):
    batches = [[(1, stamp(0))] * 4, [(2, stamp(9))], [(3, stamp(0, day=2))], [(1, stamp(9, day=2))] * 4, [(9, stamp(20, day=2))]]
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    stream = mention_stream(spark, tmp_path, batches)
    counting = detectors.write_stream(detectors.mention_counts_stream(stream), "hourly_mentions", out, ck, once=True)
    counting.awaitTermination()
    hourly = spark.readStream.schema(detectors.COUNTS_SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{out}/hourly_mentions")
    detecting = detectors.write_stream(
        detectors.escalation_stream(hourly, forget_seconds=6 * 3600), "escalation_events", out, ck, once=True
    )
    detecting.awaitTermination()
    got = spark.read.schema(detectors.ESCALATION_SCHEMA).parquet(f"{out}/escalation_events").where("GlobalEventID = 1")
    # With its first hour remembered, the second would be 4 of 8.
    assert rows_of(got, "mentions_last_24h", "mentions_this_hour") == [(4, 4), (4, 4)]
    removed = [op["numRowsRemoved"] for p in detecting.recentProgress for op in p["stateOperators"]]
    assert sum(removed) >= 1


def test_refresh_removes_days_that_became_empty(spark, tmp_path):
    from wirepulse.plans import results

    rows = spark.createDataFrame([("a", 20240101), ("b", 20240102), ("c", None)], "x string, date int")
    results.write_result(rows, "r", str(tmp_path), by="date")
    days = spark.createDataFrame([(20240102,), (None,)], "_day int")
    results.write_days(rows.where("x = 'z'"), "r", str(tmp_path), days)
    back = results.read_result(spark, str(tmp_path), "r")
    assert back.dtypes == rows.dtypes and rows_of(back) == [("a", 20240101)]
