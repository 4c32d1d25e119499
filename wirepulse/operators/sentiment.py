"""Tone analyses: correlation, trend, lag, themes and extreme events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wirepulse.functions.columns import calendar_day, filled, first_item
from wirepulse.functions.lookups import CONTINENTS, with_label
from wirepulse.operators.ranking import keep_top_ranked
from wirepulse.operators.rollups import country_day, located


def tone_source_correlation(events: DataFrame) -> DataFrame:
    """Pearson correlation of tone and number of sources per country and publication date."""
    known = events.where(F.col("AvgTone").isNotNull() & F.col("NumSources").isNotNull())
    return correlation_from(country_day(known))


def correlation_from(rollup: DataFrame) -> DataFrame:
    return rollup.where("paired_rows > 0").select(
        "country",
        "date",
        F.col("paired_tone").alias("avg_tone"),
        F.col("paired_sources").alias("avg_sources"),
        F.col("tone_sources").alias("tone_sources_correlation"),
        F.col("paired_events").alias("sample_size"),
    )


def sentiment_trend(events: DataFrame, *, days: int = 3) -> DataFrame:
    """Daily tone per country with its moving average over the last observed days."""
    return trend_from(country_day(events), days=days)


def trend_from(rollup: DataFrame, *, days: int = 3) -> DataFrame:
    recent = Window.partitionBy("country").orderBy("date").rowsBetween(1 - days, 0)
    return rollup.select(
        "country",
        "date",
        F.col("tone").alias("avg_tone"),
        F.avg("tone").over(recent).alias("moving_avg_3d"),
    )


def tone_conflict_lag(events: DataFrame, *, conflict_quad: int = 3) -> DataFrame:
    """Today's tone beside the number of conflict events on the next calendar day."""
    return lag_from(country_day(events, conflict_quad))


def lag_from(rollup: DataFrame) -> DataFrame:
    """One row per country and date exists, so by calendar day the next row is the only match.

    Dates that are no calendar day order as null, first, and so stand between no two days.
    """
    ahead = Window.partitionBy("country").orderBy("day")
    follows = F.lead("day").over(ahead) == F.date_add("day", 1)
    return (
        rollup.select(
            "country",
            "date",
            calendar_day("date").alias("day"),
            F.col("tone").alias("today_avg_tone"),
            F.col("conflict_rows").alias("today_conflict_count"),
        )
        .withColumn(
            "tomorrow_conflict_count",
            F.when(follows, F.lead("today_conflict_count").over(ahead)),
        )
        .drop("day")
    )


def theme_counts(gkg: DataFrame) -> DataFrame:
    """Entries per theme, country code and year.

    A document's country is the first two-letter code between hash marks in its location
    list; a theme entry is cut at its first hash mark or comma.
    """
    return (
        gkg.where(filled("V2Themes"))
        .select(
            F.substring("DATE", 1, 4).alias("year"),
            F.regexp_extract("V2Locations", "#([A-Z]{2})#", 1).alias("country_code"),
            F.explode(F.split("V2Themes", ";")).alias("entry"),
        )
        .select("year", "country_code", first_item(first_item(F.col("entry"), "#"), ",").alias("theme"))
        .where("theme != ''")
        .groupBy("theme", "country_code", "year")
        .agg(F.count(F.lit(1)).alias("mention_count"))
    )


def themes_from(counts: DataFrame, *, k: int = 10, continents: DataFrame | None = None) -> DataFrame:
    """The continent depends on the code alone, so it is joined to counts, not to entries."""
    counted = (
        with_label(counts, "country_code", "continent", CONTINENTS, continents, missing="Unknown")
        .groupBy("theme", "continent", "year")
        .agg(F.sum("mention_count").alias("mention_count"))
    )
    return keep_top_ranked(counted, ["continent", "year"], "mention_count", k)


def gkg_themes_continent(gkg: DataFrame, *, k: int = 10, continents: DataFrame | None = None) -> DataFrame:
    """Most frequent themes per continent and year; ties share a rank."""
    return themes_from(theme_counts(gkg), k=k, continents=continents)


def extreme_tone_events(events: DataFrame, *, n: int = 15) -> DataFrame:
    """The ``n`` most hostile and ``n`` most favourable events; event id breaks ties.

    Each side is a top-n that keeps ``n`` rows per task before the final merge.
    """
    return extremes_from(toned_events(events), n=n)


def toned_events(events: DataFrame) -> DataFrame:
    return located(events).where(F.col("AvgTone").isNotNull()).select(
        "GlobalEventID",
        F.col("ActionGeo_CountryCode").alias("country"),
        "ActionGeo_FullName",
        "EventRootCode",
        "QuadClass",
        "AvgTone",
        "NumMentions",
        "Day",
    )


def extremes_from(toned: DataFrame, *, n: int = 15) -> DataFrame:
    """Of both ends of the tone; the ends of several parts hold the ends of all of them."""

    def side(direction, label: str) -> DataFrame:
        ranked = toned.orderBy(direction("AvgTone"), F.asc("GlobalEventID")).limit(n)
        return ranked.withColumn("tone_extreme_type", F.lit(label))

    return side(F.asc, "most_negative").unionByName(side(F.desc, "most_positive"))
