"""Raw files, landing, retention and the pruning of landed scans."""

from __future__ import annotations

import gzip
from datetime import date, timedelta

import pytest

from tests.conftest import plan_of, rows_of, table
from wirepulse.schema import RAW_SCHEMAS, landed_schema, raw_schema
from wirepulse.sources import landed, raw


def line(name: str, **values: str) -> str:
    return "\t".join(values.get(column, "") for column in raw_schema(name).names)


def parsed(spark, name, *lines):
    return raw.parse_lines(spark.createDataFrame([(x,) for x in lines], "value string"), name)


def test_schema_sizes():
    assert {name: len(schema.names) for name, schema in RAW_SCHEMAS.items()} == {
        "events": 61, "mentions": 16, "gkg": 27,
    }
    assert landed_schema("events").names[-4:] == ["landing", "ingest_ts", "ingest_date", "ingest_hour"]
    with pytest.raises(ValueError):
        raw_schema("other")


def test_null_tokens(spark):
    rows = [line("gkg", GKGRECORDID=str(i), DATE=text) for i, text in enumerate(["", "NA", "NULL", "None", "x", "nan "])]
    assert rows_of(parsed(spark, "gkg", *rows), "GKGRECORDID", "DATE") == [
        ("0", None), ("1", None), ("2", None), ("3", None), ("4", "x"), ("5", "nan "),
    ]


def test_short_long_quoted_and_blank_lines(spark):
    full = line("mentions", GlobalEventID="1", MentionSourceName='"open quote')
    got = parsed(spark, "mentions", "2\tonly", full, full + "\t", full + "\textra", "")
    assert rows_of(got, "GlobalEventID", "EventTimeDate", "MentionSourceName") == [
        (1, None, '"open quote'), (2, "only", None),
    ]


@pytest.mark.parametrize("text, whole, real", [
    ("12", 12, 12.0), (" 12 ", 12, 12.0), ("12.0", 12, 12.0), ("1e3", 1000, 1000.0), ("-5", -5, -5.0),
    ("12.5", None, 12.5), ("abc", None, None), ("12d", None, None), ("12f", None, None), ("0x1p3", None, None),
    ("99999999999", None, 99999999999.0), ("NA", None, None),
])
def test_numeric_coercion(spark, text, whole, real):
    got = parsed(spark, "mentions", line("mentions", MentionType=text, MentionDocTone=text)).first()
    assert (got["MentionType"], got["MentionDocTone"]) == (whole, real)


def test_large_event_ids_stay_exact(spark):
    got = parsed(spark, "events", line("events", GlobalEventID="9007199254740993"))
    assert got.first()["GlobalEventID"] == 9007199254740993


def write_raw(folder):
    folder.mkdir()
    (folder / "20240305120000.export.CSV").write_text(
        line("events", GlobalEventID="1", Day="20240229") + "\n" + line("events", GlobalEventID="1", Day="20240229") + "\n"
        + line("events", GlobalEventID="x", Day="1") + "\n" + line("events", Day="2") + "\n"
    )
    with gzip.open(folder / "20240305120000.mentions.CSV.gz", "wt") as out:
        out.write(line("mentions", GlobalEventID="1", MentionTimeDate="20240305120000") + "\n")
    (folder / "20240305120000.GKG.csv").write_text(line("gkg", GKGRECORDID="g1") + "\r\n")
    (folder / "readme.txt").write_text("not data\n")


def test_files_are_routed_by_name(spark, tmp_path):
    write_raw(tmp_path / "raw")
    raw_dir = str(tmp_path / "raw")
    assert raw.read_raw(spark, raw_dir, "events").count() == 4
    assert rows_of(raw.read_raw(spark, raw_dir, "mentions"), "GlobalEventID") == [(1,)]
    assert rows_of(raw.read_raw(spark, raw_dir, "gkg"), "GKGRECORDID", "Extras") == [("g1", None)]


def test_ingest_cycle(spark, tmp_path, now):
    write_raw(tmp_path / "raw")
    out = str(tmp_path / "out")
    landed.ingest(spark, str(tmp_path / "raw"), out, now)
    events = landed.read_events(spark, out)
    # One copy of id 1; both rows without a readable id; the event date is not the ingest date.
    assert rows_of(events, "GlobalEventID", "Day") == [(None, 1), (None, 2), (1, 20240229)]
    assert rows_of(events.select("ingest_date", "ingest_hour").distinct()) == [(date(2024, 3, 5), 12)]
    assert landed.read_mentions(spark, out).count() == landed.read_gkg(spark, out).count() == 1
    # The same files again: nothing is landed, and what is old goes all the same.
    landed.ingest(spark, str(tmp_path / "raw"), out, now)
    assert landed.read_gkg(spark, out).count() == 1 and landed.read_events(spark, out).count() == 3
    again = tmp_path / "raw" / "20240305151500.GKG.csv"
    again.write_text(line("gkg", GKGRECORDID="g2") + "\n" + line("gkg", GKGRECORDID="g3") + "\tmore\n")
    landed.ingest(spark, str(tmp_path / "raw"), out, now + timedelta(hours=3), compact=True)
    assert rows_of(landed.read_gkg(spark, out), "GKGRECORDID", "ingest_hour") == [("g2", 15)]
    assert landed.read_events(spark, out).count() == landed.read_mentions(spark, out).count() == 0
    log = spark.read.parquet(f"{out}/{landed.INGEST_LOG}").where("table = 'gkg'")
    assert rows_of(log, "files", "lines", "over_long") == [(1, 1, 0), (1, 2, 1)]


def test_events_landed_before_are_known_as_long_as_they_are_kept(spark, tmp_path, now):
    write_raw(tmp_path / "raw")
    out = str(tmp_path / "out")
    landed.ingest(spark, str(tmp_path / "raw"), out, now, retention_hours=6)
    (tmp_path / "raw" / "20240305160000.export.CSV").write_text(line("events", GlobalEventID="1") + "\n" + line("events", GlobalEventID="2") + "\n")
    landed.ingest(spark, str(tmp_path / "raw"), out, now + timedelta(hours=4), retention_hours=6)
    assert rows_of(landed.read_events(spark, out).where("GlobalEventID > 0"), "GlobalEventID") == [(1,), (2,)]


@pytest.mark.parametrize("at", ["rows", "marks"])
def test_landing_broken_off_is_done_anew(spark, tmp_path, now, at, monkeypatch):
    write_raw(tmp_path / "raw")
    out = str(tmp_path / "out")
    with monkeypatch.context() as patch:
        def broken(*_):
            raise KeyboardInterrupt

        patch.setattr(landed, "_show" if at == "marks" else "is_landed", broken)
        with pytest.raises(KeyboardInterrupt):
            landed.ingest(spark, str(tmp_path / "raw"), out, now)
    assert not (tmp_path / "out" / landed.LEASES / "events").exists()
    landed.ingest(spark, str(tmp_path / "raw"), out, now)
    assert landed.read_events(spark, out).count() == 3
    assert landed.read_mentions(spark, out).count() == landed.read_gkg(spark, out).count() == 1


def test_a_writer_between_rows_and_marks_of_another(spark, tmp_path, now, monkeypatch):
    """Each landing has a folder of its own, so a second one neither clears nor shows the first."""
    out = str(tmp_path / "out")
    marks = spark.createDataFrame([("one", now)], landed.MARKS)

    def rows(name):
        return landed.stamp(table(spark, "gkg", [{"GKGRECORDID": name}]), now)

    show = landed._show

    def second_first(spark_, pending, place):
        monkeypatch.setattr(landed, "_show", show)
        assert landed.land_once(rows("b"), marks, "gkg", out, "second")
        assert rows_of(landed.read_gkg(spark, out), "GKGRECORDID") == [("b",)]
        show(spark_, pending, place)

    monkeypatch.setattr(landed, "_show", second_first)
    assert landed.land_once(rows("a"), marks, "gkg", out, "first")
    assert rows_of(landed.read_gkg(spark, out), "GKGRECORDID", "landing") == [("a", "first"), ("b", "second")]
    assert landed.landed_marks(spark, out, "gkg").count() == 2
    assert not landed.land_once(rows("c"), marks, "gkg", out, "first")
    assert landed.read_gkg(spark, out).count() == 2


def test_overlapping_cycles_land_a_file_once(spark, tmp_path, now, monkeypatch):
    write_raw(tmp_path / "raw")
    out = str(tmp_path / "out")
    show, met = landed._show, []

    def another_cycle(spark_, pending, place):
        if not met:
            met.append(place)
            landed.ingest(spark, str(tmp_path / "raw"), out, now)
        show(spark_, pending, place)

    monkeypatch.setattr(landed, "_show", another_cycle)
    landed.ingest(spark, str(tmp_path / "raw"), out, now)
    assert landed.read_events(spark, out).count() == 3
    assert landed.read_mentions(spark, out).count() == landed.read_gkg(spark, out).count() == 1
    with landed.cycle_lease(spark, out, "gkg", now), pytest.raises(landed.CycleRunning), landed.cycle_lease(spark, out, "gkg", now):
        pass
    monkeypatch.setattr(landed, "ABANDONED", timedelta(seconds=-5))
    with landed.cycle_lease(spark, out, "gkg", now), landed.cycle_lease(spark, out, "gkg", now):
        pass


def test_refused_lines_are_kept_with_reason_and_file(spark, tmp_path, now):
    write_raw(tmp_path / "raw")
    bad = tmp_path / "raw" / "20240305130000.GKG.csv"
    bad.write_text(line("gkg", GKGRECORDID="g2") + "\n\n" + line("gkg", GKGRECORDID="g3") + "\tmore\n" + "short\n")
    out = str(tmp_path / "out")
    landed.ingest(spark, str(tmp_path / "raw"), out, now)
    refused = landed.rejects(spark, out, "gkg")
    assert rows_of(refused, "line", "reason") == [("", "blank"), (line("gkg", GKGRECORDID="g3") + "\tmore", "too many fields")]
    assert all(row["file"].endswith(bad.name) for row in refused.collect())
    assert landed.rejects(spark, out, "events").count() == 0
    log = spark.read.parquet(f"{out}/{landed.INGEST_LOG}").where("table = 'gkg'").first()
    assert log["lines"] == landed.read_gkg(spark, out).count() + refused.count()


def test_a_query_planned_before_files_expire_ends_after(spark, tmp_path, now):
    out = str(tmp_path)
    for hours in (0, 5):
        landed.land(table(spark, "gkg", [{"GKGRECORDID": str(hours)}]), "gkg", out, now - timedelta(hours=hours))
    planned = landed.read_gkg(spark, out)
    planned._jdf.queryExecution().executedPlan()
    assert landed.expire(spark, out, "gkg", now, hours=2, grace=timedelta(hours=1)) == 0
    assert rows_of(landed.read_gkg(spark, out), "GKGRECORDID") == [("0",)]
    assert planned.count() == 2
    assert landed.expire(spark, out, "gkg", now + timedelta(minutes=61), hours=2, grace=timedelta(hours=1)) == 1
    assert landed.read_gkg(spark, out).count() == 1


def test_marks_outlive_their_rows_while_the_file_is_there(spark, tmp_path, now):
    write_raw(tmp_path / "raw")
    raw_dir, out = str(tmp_path / "raw"), str(tmp_path / "out")
    landed.ingest(spark, raw_dir, out, now)
    for hours in (3, 4):
        landed.ingest(spark, raw_dir, out, now + timedelta(hours=hours))
        assert landed.read_events(spark, out).count() == 0
        assert landed.landed_marks(spark, out, "events").count() == 1
    assert not list((tmp_path / "out" / "events").glob("landing=*"))
    assert len(list((tmp_path / "out" / landed.LEDGER / "events").glob("edition-*"))) == 1
    (tmp_path / "raw" / "20240305120000.export.CSV").unlink()
    (tmp_path / "raw" / "20240305180000.export.CSV").write_text(line("events", GlobalEventID="8") + "\n")
    landed.ingest(spark, raw_dir, out, now + timedelta(hours=6))
    landed.ingest(spark, raw_dir, out, now + timedelta(hours=9))
    assert [row["path"][-15:] for row in landed.landed_marks(spark, out, "events").collect()] == ["0000.export.CSV"]
    abandoned = tmp_path / "out" / "events" / landed.PENDING / "old"
    abandoned.mkdir(parents=True)
    landed.sweep(spark, raw_dir, out, "events", now + timedelta(days=9000))
    assert not abandoned.exists()


def test_archives_are_refused(spark, tmp_path, now):
    write_raw(tmp_path / "raw")
    (tmp_path / "raw" / "20240305130000.export.CSV.zip").write_bytes(b"PK\x03\x04")
    with pytest.raises(raw.UnreadableFiles, match="export.CSV.zip"):
        landed.ingest(spark, str(tmp_path / "raw"), str(tmp_path / "out"), now)
    with pytest.raises(raw.UnreadableFiles):
        raw.read_raw(spark, str(tmp_path / "raw"), "events")


def test_retention_is_exact_within_an_hour(spark, tmp_path, now):
    out = str(tmp_path)
    rows = table(spark, "gkg", [{"GKGRECORDID": "a"}])
    for minutes in (0, 30, 90, 200):
        landed.land(rows, "gkg", out, now - timedelta(minutes=minutes))
    kept = landed.retain(landed.read_gkg(spark, out), now, hours=1)
    assert kept.count() == 2
    assert landed.expire(spark, out, "gkg", now, hours=2) == 1
    assert landed.read_gkg(spark, out).count() == 3
    # The bound falls inside the oldest partition left, which is rewritten, then dropped.
    landed.expire(spark, out, "gkg", now - timedelta(minutes=45), hours=1)
    assert landed.read_gkg(spark, out).count() == 3
    assert landed.expire(spark, out, "gkg", now, hours=1) == 1
    assert landed.read_gkg(spark, out).count() == 2


def test_boundary_partition_keeps_its_recent_rows(spark, tmp_path, now):
    out = str(tmp_path)
    rows = table(spark, "gkg", [{"GKGRECORDID": "a"}])
    for minutes in (25, 5):
        landed.land(rows, "gkg", out, now - timedelta(minutes=minutes))
    assert landed.expire(spark, out, "gkg", now + timedelta(minutes=50), hours=1) == 1
    assert landed.read_gkg(spark, out).count() == 1
    # One landing with rows on both sides of the bound stays, its older rows are left out.
    mixed = landed.stamp(rows, now - timedelta(minutes=9)).unionByName(landed.stamp(rows, now - timedelta(minutes=2)))
    landed.land_once(mixed, None, "gkg", out)
    assert landed.expire(spark, out, "gkg", now + timedelta(minutes=54), hours=1) == 0
    assert landed.read_gkg(spark, out).count() == 2


def test_since_prunes_partitions(spark, tmp_path, now):
    rows = table(spark, "gkg", [{"GKGRECORDID": "a"}])
    for days in (0, 1, 2):
        landed.land(rows, "gkg", str(tmp_path), now - timedelta(days=days))
    recent = landed.read_gkg(spark, str(tmp_path), since=now - timedelta(days=1))
    assert recent.count() == 2
    filters = plan_of(recent).split("PartitionFilters: [", 1)[1].split("]", 1)[0]
    assert "ingest_date" in filters and "ingest_hour" in filters


def test_distinct_events_keeps_rows_without_id(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (None, "c")], "GlobalEventID long, x string")
    assert rows_of(landed.distinct_events(df), "GlobalEventID") == [(None,), (None,), (1,)]


def test_distinct_events_combines_before_the_shuffle(spark):
    df = spark.createDataFrame([(1, "a")], "GlobalEventID long, x string")
    plan = plan_of(landed.distinct_events(df))
    assert plan.index("Aggregate") < plan.index("Exchange") < plan.rindex("Aggregate")


def test_shared_input_reads_only_its_columns(spark, tmp_path, now):
    landed.land(table(spark, "events", [{"GlobalEventID": 1}]), "events", str(tmp_path), now)
    cached = landed.shared_input(landed.read_events(spark, str(tmp_path)), ["GlobalEventID", "Day"])
    try:
        assert cached.count() == 1
        assert "ReadSchema: struct<GlobalEventID:bigint,Day:int>" in plan_of(cached)
    finally:
        cached.unpersist()


def test_file_pattern_ignores_case():
    assert raw.file_pattern("gkg") == "*.[gG][kK][gG].*"


