"""Every registered query with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, TimestampNTZType, TimestampType

from parity import landing, oracle, sample_tables
from wirepulse.operators import views
from wirepulse.plans.batch import run_analyses
from wirepulse.plans.registry import ANALYSES, Analysis
from wirepulse.plans.results import read_result, read_results
from wirepulse.schema import landed_schema
from wirepulse.session import scratch_path
from wirepulse.sources import landed, raw
from wirepulse.streaming import detectors, refresh, sums
from wirepulse.streaming.ingest import ingest_stream

Query = Callable[[SparkSession, str], DataFrame]

NOW = datetime(2024, 1, 20, tzinfo=timezone.utc)
KEEP_HOURS = 48

PARSED_EVENTS = (
    "GlobalEventID", "Day", "Actor1CountryCode", "Actor1EthnicCode", "Actor2CountryCode", "Actor2EthnicCode",
    "EventRootCode", "QuadClass", "GoldsteinScale", "NumMentions", "NumSources", "NumArticles", "AvgTone",
    "ActionGeo_FullName", "ActionGeo_CountryCode", "DATEADDED",
)
PARSED_SQL = (
    'GlobalEventID Day Actor1CountryCode Actor1EthnicCode Actor2CountryCode Actor2EthnicCode EventRootCode '
    'QuadClass GoldsteinScale:d NumMentions NumSources NumArticles AvgTone:d ActionGeo_FullName '
    'ActionGeo_CountryCode DATEADDED'
)
PARSED_BODY = """
    SELECT * REPLACE (nullif(Actor1EthnicCode, '') AS Actor1EthnicCode, nullif(Actor2EthnicCode, '') AS Actor2EthnicCode)
    FROM news_events"""


def present(df: DataFrame) -> DataFrame:
    """Round doubles and print timestamps, as the SQL side does."""
    shown = []
    for field in df.schema.fields:
        column = F.col(field.name)
        if isinstance(field.dataType, DoubleType):
            column = F.round(column + F.lit(float(oracle.EPSILON)), 6) + F.lit(0.0)
        elif isinstance(field.dataType, (TimestampType, TimestampNTZType)):
            column = F.date_format(column, "yyyy-MM-dd HH:mm:ss")
        shown.append(column.alias(field.name))
    return df.select(*shown)


def build(analysis: Analysis, spark: SparkSession, sf_dir: str, **settings) -> DataFrame:
    if analysis.result in ("cameo_distribution", "religion_conflict_cluster"):
        settings["regions"] = sample_tables.regions(spark, sf_dir)
    return analysis.build(*[sample_tables.landed_table(spark, sf_dir, name) for name in analysis.inputs], **settings)


def _analysis(analysis: Analysis, **settings) -> Query:
    return lambda spark, sf_dir: present(build(analysis, spark, sf_dir, **settings))


def _view(view: views.View, panel: bool) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        result = build(ANALYSES[view.result], spark, sf_dir)
        return present(view.shown(result) if panel else view.page(result))

    return run


def result_as_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = "top_news_countries"
    ordered = build(ANALYSES[name], spark, sf_dir).orderBy("date", "rank", "country")
    return views.table_json({name: ordered}, name)


def batch_row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A full batch run over the sample tables, then the size of each written result set."""
    out_dir = scratch_path(spark, "results")
    run_analyses(spark, sample_tables.tables(spark, sf_dir), out_dir)
    return views.row_counts(read_results(spark, out_dir))


def _batch_row_counts_sql() -> str:
    plain_regions = oracle.NEWS_EVENTS.replace("coalesce(r.r_name, 'Other') AS region", "'Other' AS region")
    relations = (plain_regions, oracle.MENTIONS, oracle.GKG, oracle.COUNTRY_DAY, oracle.HOURLY, oracle.BURSTS)
    counts = " UNION ALL ".join(
        f"SELECT '{name}' AS result_set, count(*) AS row_count FROM ({body})"
        for name, (_, body) in oracle.RESULTS.items()
    )
    return f"WITH {', '.join(relations)} {counts}"


def parsed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = sample_tables.raw_lines(sample_tables.news_events(spark, sf_dir), "events")
    return present(raw.parse_lines(lines, "events").select(*PARSED_EVENTS))


def parsed_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = sample_tables.raw_lines(sample_tables.mentions(spark, sf_dir), "mentions")
    return raw.parse_lines(lines, "mentions").select("GlobalEventID", "MentionTimeDate", "MentionSourceName")


def parsed_gkg(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = sample_tables.raw_lines(sample_tables.gkg(spark, sf_dir), "gkg")
    return raw.parse_lines(lines, "gkg").select("GKGRECORDID", "DATE", "Organizations", "V2Themes", "V2Locations")


def landed_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Land the mentions and scan them back with the declared schema."""
    out_dir = scratch_path(spark, "landed")
    lines = sample_tables.raw_lines(sample_tables.mentions(spark, sf_dir), "mentions")
    landed.land(raw.parse_lines(lines, "mentions"), "mentions", out_dir, NOW)
    back = landed.read_mentions(spark, out_dir, since=NOW)
    return back.select("GlobalEventID", "MentionTimeDate", "MentionSourceName", "ingest_hour")


def retained_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the retention window, their own time standing for the ingest time."""
    timed = sample_tables.load(spark, sf_dir, "events").select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ingest_ts"),
        F.to_date("ts").alias("ingest_date"),
        F.hour("ts").alias("ingest_hour"),
    )
    return landed.retain(timed, NOW, KEEP_HOURS).select("event_id", "ingest_hour")


def distinct_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event delivered three times, kept once."""
    events = sample_tables.news_events(spark, sf_dir).select("GlobalEventID", "Day", "AvgTone")
    again = events.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(3)))).drop("_copy")
    return present(landed.distinct_events(again))


def streamed_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw files streamed into a landed table, each file delivered twice."""
    work = scratch_path(spark, "ingest-stream")
    lines = sample_tables.raw_lines(sample_tables.news_events(spark, sf_dir), "events")
    for delivery in (1, 2):
        lines.write.text(f"{work}/raw/delivery-{delivery}")
    ingest_stream(
        spark, f"{work}/raw/*", f"{work}/landed", f"{work}/checkpoint", pattern="part-*", once=True,
    ).awaitTermination()
    return present(spark.read.parquet(f"{work}/landed/events").select(*PARSED_EVENTS))


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = sample_tables.load(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def streamed_mention_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly mention counts of the hours that the watermark has closed."""
    work = scratch_path(spark, "mention-counts")
    mentions = sample_tables.mentions(spark, sf_dir, _event_stream(spark, sf_dir))
    counts = detectors.mention_counts_stream(mentions)
    detectors.write_stream(counts, "hourly_mentions", work, f"{work}/checkpoint", once=True).awaitTermination()
    back = spark.read.schema(detectors.COUNTS_SCHEMA).parquet(f"{work}/hourly_mentions")
    return present(back.withColumnRenamed("at", "mention_hour"))


def streamed_escalation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Escalations found by the stream in the closed hours."""
    work = scratch_path(spark, "escalation")
    mentions = sample_tables.mentions(spark, sf_dir, _event_stream(spark, sf_dir))
    for query in detectors.run_escalation(spark, mentions, work, f"{work}/checkpoint", once=True):
        query.awaitTermination()
    return present(spark.read.schema(detectors.ESCALATION_SCHEMA).parquet(f"{work}/escalation_events"))


def streamed_breaking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bursts found by the stream among events whose first hour is over."""
    work = scratch_path(spark, "breaking")
    mentions = sample_tables.mentions(spark, sf_dir, _event_stream(spark, sf_dir))
    for query in detectors.run_breaking(spark, mentions, work, f"{work}/checkpoint", once=True):
        query.awaitTermination()
    return present(spark.read.schema(detectors.BURST_SCHEMA).parquet(f"{work}/breaking_bursts"))


def refreshed_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heatmap kept current by the stream; the touched days are all days."""
    work = scratch_path(spark, "refresh")
    arrivals = sample_tables.news_events(spark, sf_dir, _event_stream(spark, sf_dir))
    refresh.refresh_results_stream(
        lambda: sample_tables.news_events(spark, sf_dir), arrivals, work, f"{work}/checkpoint",
        ["conflict_heatmap"], once=True,
    ).awaitTermination()
    back = spark.read.parquet(f"{work}/conflict_heatmap")
    return present(back.select("country", F.col("date").cast("int"), "avg_goldstein", "event_count", "avg_mentions"))


def refresh_after_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A full run over some events, more events of some days, a refresh: all days are there."""
    work = scratch_path(spark, "refresh-after-run")
    events = sample_tables.conform(sample_tables.news_events(spark, sf_dir), "events")
    late = F.col("GlobalEventID") % 5 == 0
    landed.land(events.where(~late), "events", f"{work}/store", NOW)
    tables = {"events": landed.read_events(spark, f"{work}/store"), "mentions": sample_tables.tables(spark, sf_dir)["mentions"]}
    run_analyses(spark, tables, f"{work}/out", "conflicts")
    landed.land(events.where(late), "events", f"{work}/arrived", NOW)
    landed.land(events.where(late), "events", f"{work}/store", NOW)
    arrivals = spark.readStream.schema(landed_schema("events")).parquet(f"{work}/arrived/events")
    refresh.refresh_results_stream(
        lambda: landed.read_events(spark, f"{work}/store"), arrivals, f"{work}/out", f"{work}/checkpoint",
        ["conflict_heatmap"], once=True,
    ).awaitTermination()
    return present(read_result(spark, f"{work}/out", "conflict_heatmap"))


def merged(result: str) -> Query:
    """A result after three batches merged into stored sums, the last of them twice.

    The batches cut every day, so each brings late rows to the days of the one before.
    """

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        parts = {
            "events": F.col("GlobalEventID"), "gkg": F.xxhash64("GKGRECORDID"),
            "mentions": F.xxhash64("GlobalEventID", "MentionTimeDate", "MentionSourceName"),
        }
        work = scratch_path(spark, f"merged-{result}")
        store = sums.Store(spark, f"{work}/sums")
        for number in (1, 2, 3, 3):
            tables = {
                name: sample_tables.landed_table(spark, sf_dir, name).where(F.pmod(part, F.lit(3)) == number - 1)
                for name, part in parts.items()
            }
            sums.merge_batch(tables, number, store, f"{work}/out", [result])
        return present(read_result(spark, f"{work}/out", result))

    return run


def _merged_sql(result: str) -> str:
    if result in ("cameo_distribution", "religion_conflict_cluster"):
        relations, body = oracle.RESULTS[result]
        plain = tuple(r.replace("coalesce(r.r_name, 'Other') AS region", "'Other' AS region") for r in relations)
        return oracle.query(plain, body, oracle.COLUMNS[result])
    return oracle.result_sql(result)


def merged_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources per country and date, kept current by one stream of landed events and mentions beside older rows."""
    work = scratch_path(spark, "merged-stream")
    tables = sample_tables.tables(spark, sf_dir)
    cut = {"events": F.col("GlobalEventID") % 4 == 0, "mentions": F.col("MentionTimeDate") < "20240101040000"}
    for name, old in cut.items():
        for number, rows in enumerate((tables[name].where(~old & (F.xxhash64("*") % 2 == 0)), tables[name].where(~old & (F.xxhash64("*") % 2 != 0)))):
            landed.land_once(rows.drop("landing"), None, name, f"{work}/store", f"part{number}")
    arrivals = {
        name: spark.readStream.schema(landed_schema(name)).option("maxFilesPerTrigger", 2).parquet(f"{work}/store/{name}") for name in cut
    }
    sums.merge_results_stream(
        arrivals, f"{work}/out", f"{work}/ck", ["source_diversity_index"], once=True,
        history=lambda: {name: tables[name].where(old) for name, old in cut.items()},
    ).awaitTermination()
    return present(read_result(spark, f"{work}/out", "source_diversity_index"))


def stream_then_batch_landing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some events landed by the stream, the others by a batch, in one table that expires as one."""
    work = scratch_path(spark, "stream-then-batch")
    events = sample_tables.news_events(spark, sf_dir)
    late = F.col("GlobalEventID") % 3 == 0
    sample_tables.raw_lines(events.where(~late), "events").write.text(f"{work}/raw")
    ingest_stream(
        spark, f"{work}/raw", f"{work}/landed", f"{work}/checkpoint", pattern="part-*", retention_hours=1, once=True,
    ).awaitTermination()
    now = datetime.now(timezone.utc)
    rows = landed.stamp(raw.parse_lines(sample_tables.raw_lines(events.where(late), "events"), "events"), now)
    marks = spark.createDataFrame([("batch", now)], landed.MARKS)
    landed.land_once(rows, marks, "events", f"{work}/landed")
    landed.expire(spark, f"{work}/landed", "events", now, hours=2)
    return present(landed.read_events(spark, f"{work}/landed").select(*PARSED_EVENTS))


# The streams' watermark: the newest mention minus one hour. A bucket is closed when it ends
# at or before it; counts per time stamp close when the stamp is at or before it.
CLOSED_HOURLY = """closed AS (
  SELECT * FROM hourly
  WHERE mention_hour + INTERVAL 1 HOUR <= (SELECT max(seen) - INTERVAL 1 HOUR FROM mentions))"""

_MENTION_SQL = """
    SELECT GlobalEventID, strftime(seen, '%Y%m%d%H%M%S') AS MentionTimeDate, MentionSourceName FROM mentions"""

def catalog() -> dict[str, tuple[Query, str | None]]:
    """Name to Spark query and SQL twin."""
    out: dict[str, tuple[Query, str | None]] = {}
    for analysis in ANALYSES.values():
        out[f"{analysis.key.lower()}_{analysis.result}"] = (_analysis(analysis), oracle.result_sql(analysis.result))
    for key, view in views.VIEWS.items():
        out[f"{key.lower()}_page_{view.result}"] = (_view(view, panel=False), oracle.page_sql(key))
        out[f"{key.lower()}_panel_{view.result}"] = (_view(view, panel=True), oracle.panel_sql(key))
    out["v20_result_as_json"] = (result_as_json, oracle.query(
        oracle.RESULTS["top_news_countries"][0],
        "SELECT to_json({country: country, date: date, event_count: event_count, rank: rank}) AS document FROM ("
        f"{oracle.RESULTS['top_news_countries'][1]}) ORDER BY date, rank, country LIMIT {views.API_LIMIT}",
        "document",
    ))
    out["v21_batch_row_counts"] = (batch_row_counts, _batch_row_counts_sql())

    out["a09_escalation_clock_hours"] = (
        _analysis(ANALYSES["escalation_events"], frame="range"),
        oracle.query(
            (oracle.MENTIONS, oracle.HOURLY),
            oracle.RESULTS["escalation_events"][1].replace(
                "ROWS BETWEEN 23 PRECEDING", "RANGE BETWEEN INTERVAL 23 HOURS PRECEDING"
            ),
            oracle.COLUMNS["escalation_events"],
        ),
    )
    out["a16_ethnic_conflicts_weighted"] = (
        _analysis(ANALYSES["ethnic_conflicts"], weighted=True),
        oracle.query(
            (oracle.NEWS_EVENTS,),
            """SELECT ethnicity, "Day" AS date, count(GlobalEventID) AS event_count, avg(GoldsteinScale) AS avg_goldstein
               FROM (SELECT Actor1EthnicCode AS ethnicity, * FROM news_events UNION ALL
                     SELECT Actor2EthnicCode AS ethnicity, * FROM news_events)
               WHERE QuadClass >= 3 AND ethnicity <> '' GROUP BY 1, 2""",
            oracle.COLUMNS["ethnic_conflicts"],
        ),
    )

    parsed = oracle.query((oracle.NEWS_EVENTS,), PARSED_BODY, PARSED_SQL)
    out["parsed_events"] = (parsed_events, parsed)
    out["parsed_mentions"] = (parsed_mentions, f"WITH {oracle.MENTIONS} {_MENTION_SQL}")
    out["parsed_gkg"] = (parsed_gkg, f"""
        WITH {oracle.GKG} SELECT GKGRECORDID, stamp AS "DATE", Organizations, V2Themes, V2Locations FROM gkg""")
    out["landed_mentions"] = (
        landed_mentions, f"WITH {oracle.MENTIONS} SELECT *, {NOW.hour} AS ingest_hour FROM ({_MENTION_SQL})",
    )
    out["retained_events"] = (retained_events, """
        SELECT event_id, CAST(hour(ts) AS INTEGER) AS ingest_hour FROM events
        WHERE ts >= TIMESTAMP '2024-01-18 00:00:00'""")
    out["distinct_events"] = (
        distinct_events,
        oracle.query((oracle.NEWS_EVENTS,), "SELECT * FROM news_events", "GlobalEventID Day AvgTone:d"),
    )
    out["streamed_ingest"] = (streamed_ingest, parsed)
    out["streamed_mention_counts"] = (streamed_mention_counts, oracle.query(
        (oracle.MENTIONS, oracle.HOURLY, CLOSED_HOURLY),
        "SELECT GlobalEventID, mention_hour, n AS mentions FROM closed", "GlobalEventID mention_hour:t mentions",
    ))
    out["streamed_escalation"] = (streamed_escalation, oracle.query(
        (oracle.MENTIONS, oracle.HOURLY, CLOSED_HOURLY),
        oracle.RESULTS["escalation_events"][1].replace("FROM hourly", "FROM closed"),
        oracle.COLUMNS["escalation_events"],
    ))
    out["streamed_breaking"] = (streamed_breaking, oracle.query(
        (oracle.MENTIONS, oracle.BURSTS),
        """SELECT GlobalEventID, first_at AS first_mention_time, n AS mentions_in_first_hour FROM bursts
           WHERE first_at + INTERVAL 1 HOUR < (SELECT max(seen) - INTERVAL 2 HOUR FROM mentions)""",
        "GlobalEventID first_mention_time:t mentions_in_first_hour",
    ))
    out["refresh_after_run"] = (refresh_after_run, oracle.result_sql("conflict_heatmap"))
    out["stream_then_batch_landing"] = (stream_then_batch_landing, parsed)
    out["a01_heatmap_of_shared_input"] = (
        lambda spark, sf_dir: present(landing.heatmap_of_shared_input(spark, sf_dir)), oracle.result_sql("conflict_heatmap"),
    )
    out |= landing.twins()
    for analysis in ANALYSES.values():
        out[f"merged_{analysis.key.lower()}_{analysis.result}"] = (merged(analysis.result), _merged_sql(analysis.result))
    out["merged_stream_of_two_tables"] = (merged_stream, oracle.result_sql("source_diversity_index"))
    out["streamed_refresh_heatmap"] = (refreshed_heatmap, oracle.result_sql("conflict_heatmap"))
    return out
