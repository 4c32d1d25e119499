"""Queries over landing, retention, rejects and runs, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timedelta, timezone
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parity import oracle, sample_tables
from wirepulse.operators import actors, conflict, media
from wirepulse.plans.batch import run_analyses
from wirepulse.plans.registry import SHARED_COLUMNS
from wirepulse.plans.results import read_result, run_log
from wirepulse.session import file_system, materialise, scratch_path
from wirepulse.sources import landed, raw
from wirepulse.streaming.ingest import ingest_stream

NOW = datetime(2024, 1, 20, tzinfo=timezone.utc)
KINDS = {"events": "export", "mentions": "mentions", "gkg": "gkg"}

Twin = tuple[Callable[[SparkSession, str], DataFrame], str]


def deliver(lines: DataFrame, table: str, raw_dir: str, name: str) -> None:
    """Put lines into the raw folder as files named the way the feed names them."""
    spark = lines.sparkSession
    lines.write.text(f"{raw_dir}-{name}")
    files, source = file_system(spark, f"{raw_dir}-{name}/part-*")
    files.mkdirs(file_system(spark, raw_dir)[1])
    for number, status in enumerate(files.globStatus(source)):
        files.rename(status.getPath(), file_system(spark, f"{raw_dir}/{name}{number}.{KINDS[table]}.CSV")[1])


def events_lines(spark: SparkSession, sf_dir: str, where: str = "true") -> DataFrame:
    return sample_tables.raw_lines(sample_tables.news_events(spark, sf_dir).where(where), "events")


def brief(events: DataFrame) -> DataFrame:
    return events.select("GlobalEventID", "Day", "ActionGeo_CountryCode", "NumMentions")


BRIEF_SQL = f'WITH {oracle.NEWS_EVENTS} SELECT GlobalEventID, "Day", ActionGeo_CountryCode, NumMentions FROM news_events'


def ingested_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two cycles over one raw folder, with some events delivered again in a new file between them."""
    work = scratch_path(spark, "ingested-twice")
    deliver(events_lines(spark, sf_dir, "GlobalEventID % 3 <> 0"), "events", f"{work}/raw", "a")
    landed.ingest(spark, f"{work}/raw", f"{work}/out", NOW)
    deliver(events_lines(spark, sf_dir, "GlobalEventID % 3 <> 1"), "events", f"{work}/raw", "b")
    landed.ingest(spark, f"{work}/raw", f"{work}/out", NOW + timedelta(minutes=15))
    return brief(landed.read_events(spark, f"{work}/out"))


def two_writers_one_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four landings at the same time, one of them named and tried twice."""
    out = scratch_path(spark, "two-writers")
    events = sample_tables.conform(sample_tables.news_events(spark, sf_dir), "events")

    def write(part: int) -> None:
        rows = landed.stamp(events.where(f"GlobalEventID % 4 = {part}"), NOW)
        marks = spark.createDataFrame([(f"part {part}", NOW)], landed.MARKS)
        landed.land_once(rows, marks, "events", out, f"writer{part}")

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(write, range(4)))
    write(2)
    return brief(landed.read_events(spark, out))


def routed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of three kinds of files in one folder, told apart by name."""
    raw_dir = f"{scratch_path(spark, 'routed')}/raw"
    derived = {"events": sample_tables.news_events, "mentions": sample_tables.mentions, "gkg": sample_tables.gkg}
    for table, derive in derived.items():
        deliver(sample_tables.raw_lines(derive(spark, sf_dir), table), table, raw_dir, f"x-{table}")
    counts = [
        raw.read_raw(spark, raw_dir, table).agg(F.lit(table).alias("kind"), F.count("*").alias("n_rows")) for table in derived
    ]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


ROUTED_SQL = f"""WITH {oracle.NEWS_EVENTS} SELECT 'events' AS kind, count(*) AS n_rows FROM news_events
    UNION ALL SELECT 'mentions', count(*) FROM events UNION ALL SELECT 'gkg', count(*) FROM documents"""


def rejected_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of a cycle, landed or refused for a reason: a fifth too long, a tenth of the rest blank."""
    work = scratch_path(spark, "rejects")
    events = sample_tables.news_events(spark, sf_dir)
    spoilt = {"GlobalEventID % 5 = 0": F.concat("value", F.lit("\tmore")), "GlobalEventID % 5 <> 0 AND GlobalEventID % 10 = 1": F.lit("")}
    for number, (where, line) in enumerate(spoilt.items()):
        deliver(sample_tables.raw_lines(events.where(where), "events").select(line.alias("value")), "events", f"{work}/raw", f"s{number}")
    good = sample_tables.raw_lines(events.where("GlobalEventID % 5 <> 0 AND GlobalEventID % 10 <> 1"), "events")
    deliver(good, "events", f"{work}/raw", "g")
    landed.ingest(spark, f"{work}/raw", f"{work}/out", NOW)
    refused = landed.rejects(spark, f"{work}/out", "events").groupBy("reason").agg(F.count("*").alias("n_lines"))
    return refused.unionByName(landed.read_events(spark, f"{work}/out").agg(F.lit("landed").alias("reason"), F.count("*").alias("n_lines")))


REJECTED_SQL = f"""WITH {oracle.NEWS_EVENTS}
    SELECT CASE WHEN GlobalEventID % 5 = 0 THEN 'too many fields' WHEN GlobalEventID % 10 = 1 THEN 'blank' ELSE 'landed' END AS reason,
      count(*) AS n_lines FROM news_events GROUP BY 1"""


def expiring_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream with a retention into a table that holds rows of long ago: these go."""
    work = scratch_path(spark, "expiring-stream")
    old = sample_tables.conform(sample_tables.news_events(spark, sf_dir).where("GlobalEventID % 2 = 0"), "events")
    landed.land(old, "events", f"{work}/out", NOW)
    deliver(events_lines(spark, sf_dir, "GlobalEventID % 2 = 1"), "events", f"{work}/raw", "a")
    ingest_stream(spark, f"{work}/raw", f"{work}/out", f"{work}/ck", retention_hours=1, once=True).awaitTermination()
    left = landed.file_system(spark, f"{work}/out/events/landing=*/ingest_date={NOW.date()}/*/part-*")
    assert not left[0].globStatus(left[1])
    return brief(landed.read_events(spark, f"{work}/out"))


def logged_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run log after a run that succeeds and one that has no mentions to read."""
    out = scratch_path(spark, "logged-runs")
    tables = sample_tables.tables(spark, sf_dir)
    run_analyses(spark, tables, out, "conflicts")
    try:
        run_analyses(spark, tables | {"mentions": tables["mentions"].drop("GlobalEventID")}, out, "conflicts")
    except RuntimeError:
        pass
    log = run_log(spark, out)
    return log.select(F.split("run_id", "-")[0].alias("analyses"), "status", "failed", (F.col("ended_at") >= F.col("started_at")).alias("in_order"))


LOGGED_SQL = """SELECT 'conflicts' AS analyses, 'success' AS status, NULL::VARCHAR AS failed, true AS in_order FROM (SELECT count(*) FROM events)
    UNION ALL SELECT 'conflicts', 'failed', 'escalation_events', true"""


def diversity_of_merged_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources per country over all days from stored daily sketches, beside whether they are within 3 % of the exact number."""
    tables = sample_tables.tables(spark, sf_dir)
    stored = materialise(media.source_sketches(tables["mentions"], tables["events"]), scratch_path(spark, "sketches"))
    merged = media.diversity_over_days(stored).select("country", "unique_sources", "total_mentions")
    placed = media.source_counts(tables["mentions"]).join(media.event_places(tables["events"]), "GlobalEventID")
    exact = placed.groupBy(F.col("country").alias("_country")).agg(F.count_distinct("MentionSourceName").alias("_exact"))
    near = F.abs(F.col("unique_sources") - F.col("_exact")) <= 0.03 * F.col("_exact")
    return merged.join(exact, F.col("country") == F.col("_country")).select("country", "total_mentions", near.alias("within_3_percent"))


DIVERSITY_SQL = f"""WITH {oracle.NEWS_EVENTS}, {oracle.MENTIONS}
    SELECT ActionGeo_CountryCode AS country, count(*) AS total_mentions, true AS within_3_percent
    FROM mentions JOIN news_events USING (GlobalEventID)
    WHERE ActionGeo_CountryCode IS NOT NULL AND MentionSourceName IS NOT NULL GROUP BY 1"""


RESUMED = ("conflict_heatmap", "conflict_pairs", "escalation_events", "diplomatic_network", "ethnic_conflicts")


def resumed_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run that fails in one analysis, resumed: what each start wrote, and the sizes of the results."""
    out = scratch_path(spark, "resumed-run")
    tables = sample_tables.tables(spark, sf_dir)
    try:
        run_analyses(spark, tables | {"mentions": tables["mentions"].drop("GlobalEventID")}, out, "conflicts", run_id="night")
    except RuntimeError:
        pass
    second = run_analyses(spark, tables, out, "conflicts", run_id="night", retries=1)
    sizes = [
        read_result(spark, out, name).agg(F.lit(name).alias("result_set"), F.lit(2 if name in second else 1).alias("start"), F.count("*").alias("n_rows"))
        for name in RESUMED
    ]
    return reduce(DataFrame.unionByName, sizes)


def _resumed_sql() -> str:
    relations = (oracle.NEWS_EVENTS, oracle.MENTIONS, oracle.HOURLY)
    counts = " UNION ALL ".join(
        f"SELECT '{name}' AS result_set, {2 if name == 'escalation_events' else 1} AS start, count(*) AS n_rows FROM ({oracle.RESULTS[name][1]})"
        for name in RESUMED
    )
    return f"WITH {', '.join(relations)} {counts}"


def heatmap_of_shared_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The heatmap from a cached input that keeps only the analyses' columns."""
    events = landed.shared_input(sample_tables.landed_table(spark, sf_dir, "events"), SHARED_COLUMNS["events"])
    return conflict.conflict_heatmap(events)


#: Countries of the shipped region table, and two that it does not know.
COUNTRIES = ("US", "MX", "BR", "UK", "GM", "RS", "UP", "CH", "PK", "IR", "IS", "NI", "EG", "AS", "NZ", "ZZ", "XX")


def cameo_by_shipped_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types by the regions that the library ships."""
    codes = F.array(*map(F.lit, COUNTRIES))
    events = sample_tables.landed_table(spark, sf_dir, "events").withColumn(
        "ActionGeo_CountryCode", F.get(codes, (F.col("GlobalEventID") % len(COUNTRIES)).cast("int"))
    )
    return actors.cameo_distribution(events)


_CODES = ", ".join(f"'{code}'" for code in COUNTRIES)
SHIPPED_SQL = f"""WITH {oracle.NEWS_EVENTS}, places AS (
      SELECT *, [{_CODES}][1 + GlobalEventID % {len(COUNTRIES)}] AS code FROM news_events
    )
    SELECT EventRootCode, event_description, CASE
        WHEN code IN ('US', 'MX') THEN 'North America' WHEN code = 'BR' THEN 'South America' WHEN code IN ('UK', 'GM', 'UP') THEN 'Europe'
        WHEN code = 'RS' THEN 'Europe/Asia' WHEN code IN ('CH', 'PK') THEN 'Asia' WHEN code IN ('IR', 'IS') THEN 'Middle East'
        WHEN code IN ('NI', 'EG') THEN 'Africa' WHEN code IN ('AS', 'NZ') THEN 'Oceania' ELSE 'Other' END AS region,
      CAST(substr(DATEADDED, 1, 8) AS INTEGER) AS date, count(GlobalEventID) AS event_count
    FROM places LEFT JOIN (VALUES {oracle.LABELS}) AS labels(root, event_description) ON EventRootCode = root
    GROUP BY 1, 2, 3, 4"""


def twins() -> dict[str, Twin]:
    return {
        "ingested_twice": (ingested_twice, BRIEF_SQL),
        "two_writers_one_table": (two_writers_one_table, BRIEF_SQL),
        "routed_files": (routed_files, ROUTED_SQL),
        "rejected_lines": (rejected_lines, REJECTED_SQL),
        "expiring_stream": (expiring_stream, f"{BRIEF_SQL} WHERE GlobalEventID % 2 = 1"),
        "a15_merged_days": (diversity_of_merged_days, DIVERSITY_SQL),
        "resumed_run": (resumed_run, _resumed_sql()),
        "logged_runs": (logged_runs, LOGGED_SQL),
        "a04_shipped_regions": (cameo_by_shipped_regions, SHIPPED_SQL),
    }
