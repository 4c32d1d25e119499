"""Media analyses: busiest countries, coverage, organisations, source diversity, breaking news."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wirepulse.functions.columns import filled, published_date, stamp_number, wall_clock
from wirepulse.operators.ranking import keep_top_ranked
from wirepulse.operators.rollups import country_day, country_event_day

#: A sketch of distinct sources has 2 to this power registers; its standard error is 0.8 %.
SKETCH_BITS = 14


def top_news_countries(events: DataFrame, *, k: int = 10) -> DataFrame:
    """Countries with the most events per publication date; ties share a rank."""
    return busiest_from(country_day(events), k=k)


def busiest_from(rollup: DataFrame, *, k: int = 10) -> DataFrame:
    counted = rollup.select("country", "date", F.col("events").alias("event_count"))
    return keep_top_ranked(counted, ["date"], "event_count", k)


def media_coverage_ratio(events: DataFrame) -> DataFrame:
    """Mentions per event of each country and event date."""
    return coverage_from(country_event_day(events))


def coverage_from(rollup: DataFrame) -> DataFrame:
    return rollup.select(
        "country",
        "date",
        F.col("mentions").alias("total_mentions"),
        F.col("events").alias("total_events"),
        F.try_divide("mentions", "events").alias("mentions_per_event"),
    )


def organization_counts(gkg: DataFrame) -> DataFrame:
    """Entries per organisation and publication date."""
    return (
        gkg.where(filled("Organizations"))
        .select(
            F.substring("DATE", 1, 8).alias("date"),
            F.explode(F.split("Organizations", ";")).alias("entry"),
        )
        .select(F.trim("entry").alias("organization"), "date")
        .where("organization != ''")
        .groupBy("organization", "date")
        .agg(F.count(F.lit(1)).alias("mention_count"))
    )


def organizations_from(counts: DataFrame, *, k: int = 20) -> DataFrame:
    return keep_top_ranked(counts, ["date"], "mention_count", k)


def top_organizations(gkg: DataFrame, *, k: int = 20) -> DataFrame:
    """Most mentioned organisations per publication date; ties share a rank."""
    return organizations_from(organization_counts(gkg), k=k)


def source_counts(mentions: DataFrame) -> DataFrame:
    """Mentions per event and source."""
    return (
        mentions.where(F.col("MentionSourceName").isNotNull())
        .groupBy("GlobalEventID", "MentionSourceName")
        .agg(F.count(F.lit(1)).alias("mentions"))
    )


def event_places(events: DataFrame) -> DataFrame:
    return events.select(
        "GlobalEventID", F.col("ActionGeo_CountryCode").alias("country"), F.col("Day").alias("date"),
    )


def diversity_from(per_source: DataFrame, places: DataFrame, *, approx: bool = False) -> DataFrame:
    distinct = F.approx_count_distinct if approx else F.count_distinct
    return (
        per_source.join(places.where("country IS NOT NULL"), "GlobalEventID")
        .groupBy("country", "date")
        .agg(
            distinct(F.col("MentionSourceName")).alias("unique_sources"),
            F.sum("mentions").alias("total_mentions"),
        )
        .withColumn("source_diversity_index", F.log(F.col("unique_sources") + 1))
    )


def source_diversity_index(mentions: DataFrame, events: DataFrame, *, approx: bool = False) -> DataFrame:
    """Distinct sources that mention a country's events, per event date.

    Mentions are counted per event and source before the join. A story that draws a third
    of all mentions then enters the join with one row per source, not one per mention.
    """
    return diversity_from(source_counts(mentions), event_places(events), approx=approx)


def source_sketches(mentions: DataFrame, events: DataFrame) -> DataFrame:
    """Per country and event date a sketch of its distinct sources, which unlike their number can be merged."""
    placed = source_counts(mentions).join(event_places(events).where("country IS NOT NULL"), "GlobalEventID")
    return placed.groupBy("country", "date").agg(
        F.hll_sketch_agg("MentionSourceName", SKETCH_BITS).alias("sources"), F.sum("mentions").alias("total_mentions"),
    )


def diversity_over_days(sketches: DataFrame) -> DataFrame:
    """Distinct sources per country over all days of the sketches, about one percent off at most times."""
    merged = sketches.groupBy("country").agg(F.hll_union_agg("sources").alias("_sources"), F.sum("total_mentions").alias("total_mentions"))
    return merged.select("country", F.hll_sketch_estimate("_sources").alias("unique_sources"), "total_mentions").withColumn(
        "source_diversity_index", F.log(F.col("unique_sources") + 1)
    )


def tick_counts(mentions: DataFrame) -> DataFrame:
    """Mentions per event and time stamp. Stamps that are no time drop out."""
    return (
        mentions.where(F.col("GlobalEventID").isNotNull())
        .groupBy("GlobalEventID", stamp_number("MentionTimeDate").alias("stamp"))
        .agg(F.count(F.lit(1)).alias("mentions"))
        .select("GlobalEventID", wall_clock(F.col("stamp")).alias("at"), "mentions")
        .where(F.col("at").isNotNull())
    )


def bursts_from(ticks: DataFrame, *, threshold: int = 100, horizon: str = "1 hour") -> DataFrame:
    first = F.min("at").over(Window.partitionBy("GlobalEventID"))
    return (
        ticks.withColumn("first_mention_time", first)
        .where(F.col("at") <= F.col("first_mention_time") + F.expr(f"INTERVAL {horizon}"))
        .groupBy("GlobalEventID", "first_mention_time")
        .agg(F.sum("mentions").alias("mentions_in_first_hour"))
        .where(F.col("mentions_in_first_hour") >= threshold)
    )


def first_hour_bursts(mentions: DataFrame, *, threshold: int = 100, horizon: str = "1 hour") -> DataFrame:
    """Events with at least ``threshold`` mentions up to ``horizon`` after their first one.

    Mentions are counted per event and time stamp before the window looks for the first
    one, so a key has at most one row per second whatever its number of mentions.
    """
    return bursts_from(tick_counts(mentions), threshold=threshold, horizon=horizon)


def breaking_news(
    mentions: DataFrame,
    events: DataFrame,
    *,
    threshold: int = 100,
    horizon: str = "1 hour",
) -> DataFrame:
    """Bursts with the country and date of their event, null when the event is unknown.

    A run writes the bursts first. Their size is then known when the join is planned, so a
    short list is broadcast to the events and a long one is not.
    """
    return locate_bursts(first_hour_bursts(mentions, threshold=threshold, horizon=horizon), events)


def locate_bursts(bursts: DataFrame, events: DataFrame) -> DataFrame:
    return locate_from(bursts, event_places(events))


def locate_from(bursts: DataFrame, places: DataFrame) -> DataFrame:
    """Only events that burst enter the outer join; the others fall to a semi-join first."""
    burst_places = places.join(bursts.select("GlobalEventID"), "GlobalEventID", "left_semi")
    return bursts.join(burst_places, "GlobalEventID", "left").select(
        "GlobalEventID",
        F.col("first_mention_time").cast("timestamp").alias("first_mention_time"),
        "mentions_in_first_hour",
        "country",
        "date",
    )


def top_article_coverage(events: DataFrame) -> DataFrame:
    """Article totals per country over the whole period."""
    return articles_from(country_event_day(events.where(F.col("NumArticles").isNotNull())))


def articles_from(rollup: DataFrame) -> DataFrame:
    return (
        rollup.where("article_rows > 0")
        .groupBy("country")
        .agg(
            F.sum("articles").alias("total_articles"),
            (F.sum("articles") / F.sum("article_rows")).alias("avg_articles_per_event"),
            F.sum("article_events").alias("event_count"),
        )
    )
