"""Raw news tables derived from the shared test tables (mapping in FIXTURES.md §3)."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirepulse.schema import raw_schema
from wirepulse.session import scratch_path
from wirepulse.sources import landed

INGESTED_AT = datetime(2024, 2, 1, tzinfo=timezone.utc)

_landed: dict[tuple[str, str], str] = {}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def news_events(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """Events with the country of their user as action country.

    ``events`` may be a stream with the columns of the test table.
    """
    source = load(spark, sf_dir, "events") if events is None else events
    keyed = source.select(
        "event_id", "user_id", "event_type", "value",
        F.date_format("ts", "yyyyMMddHHmmss").alias("stamp"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )
    customer = load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = load(spark, sf_dir, "nation")
    home = nation.select(F.col("n_nationkey").alias("home_key"), F.col("n_name").alias("home"))
    other = nation.select(F.col("n_nationkey").alias("other_key"), F.col("n_name").alias("other"))
    joined = (
        keyed.join(customer, F.col("user_id") == F.col("c_custkey"))
        .join(home, F.col("c_nationkey") == F.col("home_key"))
        .join(other, F.expr("k % 25") == F.col("other_key"))
    )
    return joined.selectExpr(
        "event_id AS GlobalEventID",
        "CAST(substring(stamp, 1, 8) AS INT) AS Day",
        "CASE WHEN k % 10 = 0 THEN NULL ELSE home END AS Actor1CountryCode",
        "CASE WHEN k % 4 = 0 THEN NULL WHEN k % 4 = 1 THEN '' ELSE concat('ETH', k % 8) END AS Actor1EthnicCode",
        "CASE WHEN k % 3 = 0 THEN NULL ELSE concat('REL', k % 4) END AS Actor1Religion1Code",
        "CASE WHEN k % 6 = 0 THEN NULL ELSE upper(event_type) END AS Actor1Type1Code",
        "CASE WHEN k % 11 = 0 THEN NULL ELSE other END AS Actor2CountryCode",
        "CASE WHEN k % 5 = 0 THEN NULL WHEN k % 5 = 1 THEN '' ELSE concat('ETH', k % 8) END AS Actor2EthnicCode",
        "CASE WHEN k % 2 = 0 THEN NULL ELSE concat('REL', k % 6) END AS Actor2Religion1Code",
        "CASE WHEN k % 7 = 0 THEN NULL ELSE concat('T', k % 5) END AS Actor2Type1Code",
        "lpad(CAST(1 + k % 20 AS STRING), 2, '0') AS EventRootCode",
        "CAST(1 + event_id % 4 AS INT) AS QuadClass",
        "(k - 50) / 5.0D AS GoldsteinScale",
        "1 + k % 10 AS NumMentions",
        "1 + k % 7 AS NumSources",
        "1 + k % 13 AS NumArticles",
        "10 - value / 10 AS AvgTone",
        "concat(event_type, ', ', home) AS ActionGeo_FullName",
        "home AS ActionGeo_CountryCode",
        "stamp AS DATEADDED",
    )


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Country to region, with one region left out so that some countries have none."""
    nation, region = load(spark, sf_dir, "nation"), load(spark, sf_dir, "region")
    return (
        nation.join(region.where("r_name <> 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("n_name", "r_name")
    )


def mentions(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """Thirty days of events squeezed into ten hours, with two very hot event ids."""
    source = load(spark, sf_dir, "events") if events is None else events
    anchor = "timestamp_ntz'2024-01-01 00:00:00'"
    squeezed = (
        f"timestampadd(SECOND, CAST(floor(timestampdiff(SECOND, {anchor}, ts) / 72) AS INT), {anchor})"
    )
    return source.selectExpr(
        "*", "CAST(get_json_object(props, '$.k') AS INT) AS k",
    ).selectExpr(
        "CAST(CASE WHEN k < 30 THEN k % 2 ELSE k END AS BIGINT) AS GlobalEventID",
        f"date_format({squeezed}, 'yyyyMMddHHmmss') AS MentionTimeDate",
        "CASE WHEN k = 99 THEN NULL ELSE concat('src', user_id % 20) END AS MentionSourceName",
    )


def gkg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as knowledge-graph records."""
    return load(spark, sf_dir, "documents").selectExpr(
        "CAST(doc_id AS STRING) AS GKGRECORDID",
        "concat(2022 + doc_id % 3, '01', lpad(CAST(1 + doc_id % 28 AS STRING), 2, '0'), '000000') AS DATE",
        "concat(source, '; ', lang, ';;org', doc_id % 7) AS Organizations",
        "concat('LANG_', upper(lang), ',', n_chars, ';TOPIC_', doc_id % 12, ',5;') AS V2Themes",
        "CASE WHEN doc_id % 9 = 0 THEN NULL WHEN doc_id % 9 = 1 THEN 'junk' ELSE concat('1#Place, X#', "
        "CASE doc_id % 4 WHEN 0 THEN 'US' WHEN 1 THEN 'FR' WHEN 2 THEN 'CH' ELSE 'ZZ' END, "
        "'#A#B#1#2#3') END AS V2Locations",
    )


def conform(df: DataFrame, table: str) -> DataFrame:
    """Rows in the full raw schema, columns the mapping does not fill as null."""
    known = set(df.columns)
    return df.select(*[
        (F.col(field.name) if field.name in known else F.lit(None)).cast(field.dataType).alias(field.name)
        for field in raw_schema(table).fields
    ])


def landed_dir(spark: SparkSession, sf_dir: str) -> str:
    """Land the three derived tables once per application, as an ingest cycle would.

    The analyses then scan Parquet with declared schemas, pushed filters and pruned columns.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _landed:
        out_dir = scratch_path(spark, "landed")
        for table, derive in (("events", news_events), ("mentions", mentions), ("gkg", gkg)):
            landed.land(conform(derive(spark, sf_dir), table), table, out_dir, INGESTED_AT)
        _landed[key] = out_dir
    return _landed[key]


def landed_table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return landed.read_table(spark, landed_dir(spark, sf_dir), table)


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return landed.read_tables(spark, landed_dir(spark, sf_dir))


def raw_lines(df: DataFrame, table: str) -> DataFrame:
    """Rows as raw tab-separated text in the table's column order, null as empty field."""
    known = set(df.columns)
    fields = [
        F.coalesce(F.col(field.name).cast("string"), F.lit("")) if field.name in known else F.lit("")
        for field in raw_schema(table).fields
    ]
    return df.select(F.concat_ws("\t", *fields).alias("value"))
