"""Event rollups that several analyses read.

Each rollup is one partial/final hash aggregation whose measures carry their own
conditions, so one pass over the events can feed every analysis on the same keys. Used by
a single analysis, Catalyst prunes the measures and the scan columns it does not need.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirepulse.functions.columns import published_date


def located(events: DataFrame) -> DataFrame:
    """Events whose action country is known."""
    return events.where(F.col("ActionGeo_CountryCode").isNotNull())


def between_countries(events: DataFrame) -> DataFrame:
    """Events between actors of two different known countries."""
    one, other = F.col("Actor1CountryCode"), F.col("Actor2CountryCode")
    return events.where(one.isNotNull() & other.isNotNull() & (one != other))


def country_day(events: DataFrame, conflict_quad: int = 3) -> DataFrame:
    """Measures per action country and publication date.

    The correlation is written out: ``corr`` divides by zero under ANSI mode for a group with
    one row or a constant side, where this form yields null.
    """
    conflict = f"QuadClass >= {conflict_quad}"
    paired = "AvgTone IS NOT NULL AND NumSources IS NOT NULL"
    return (
        located(events)
        .groupBy(F.col("ActionGeo_CountryCode").alias("country"), published_date().alias("date"))
        .agg(*map(F.expr, (
            "count(GlobalEventID) AS events",
            "avg(AvgTone) AS tone",
            f"count(*) FILTER (WHERE {conflict}) AS conflict_rows",
            f"count(GlobalEventID) FILTER (WHERE {conflict}) AS conflict_events",
            f"avg(GoldsteinScale) FILTER (WHERE {conflict}) AS conflict_goldstein",
            f"avg(NumMentions) FILTER (WHERE {conflict}) AS conflict_mentions",
            f"count(*) FILTER (WHERE {paired}) AS paired_rows",
            f"count(GlobalEventID) FILTER (WHERE {paired}) AS paired_events",
            f"avg(AvgTone) FILTER (WHERE {paired}) AS paired_tone",
            f"avg(NumSources) FILTER (WHERE {paired}) AS paired_sources",
            f"""try_divide(
                covar_pop(AvgTone, NumSources) FILTER (WHERE {paired}),
                stddev_pop(AvgTone) FILTER (WHERE {paired}) * stddev_pop(NumSources) FILTER (WHERE {paired})
            ) AS tone_sources""",
        )))
    )


def country_event_day(events: DataFrame) -> DataFrame:
    """Coverage totals per action country and event date."""
    return (
        located(events)
        .groupBy(F.col("ActionGeo_CountryCode").alias("country"), F.col("Day").alias("date"))
        .agg(*map(F.expr, (
            "sum(NumMentions) AS mentions",
            "count(GlobalEventID) AS events",
            "sum(NumArticles) AS articles",
            "count(NumArticles) AS article_rows",
            "count(GlobalEventID) FILTER (WHERE NumArticles IS NOT NULL) AS article_events",
        )))
    )


def country_pair_day(events: DataFrame, conflict_quad: int = 3) -> DataFrame:
    """Directed actor-country pairs per event date."""
    conflict = f"QuadClass >= {conflict_quad}"
    return (
        between_countries(events)
        .groupBy(
            F.col("Actor1CountryCode").alias("source"),
            F.col("Actor2CountryCode").alias("target"),
            F.col("Day").alias("date"),
        )
        .agg(*map(F.expr, (
            "count(GlobalEventID) AS events",
            f"count(*) FILTER (WHERE QuadClass < {conflict_quad}) AS diplomatic_rows",
            f"count(*) FILTER (WHERE {conflict}) AS conflict_rows",
            f"count(GlobalEventID) FILTER (WHERE {conflict}) AS conflict_events",
            f"avg(GoldsteinScale) FILTER (WHERE {conflict}) AS conflict_goldstein",
        )))
    )


ROLLUPS = {
    "country_day": country_day,
    "country_event_day": country_event_day,
    "country_pair_day": country_pair_day,
}
