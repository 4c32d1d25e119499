"""Actor and region analyses: event types by region, actor matrix, religion clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirepulse.functions.columns import is_conflict, published_date
from wirepulse.functions.lookups import REGIONS, ROOT_CODE_LABELS, with_label
from wirepulse.operators.rollups import located


def cameo_counts(events: DataFrame) -> DataFrame:
    """Events per root code, country and publication date."""
    coded = located(events).where(F.col("EventRootCode").isNotNull())
    return coded.groupBy("EventRootCode", F.col("ActionGeo_CountryCode").alias("place"), published_date().alias("date")).agg(
        F.count("GlobalEventID").alias("event_count")
    )


def cameo_from(counts: DataFrame, *, regions: DataFrame | None = None) -> DataFrame:
    """Regions and labels depend on codes alone, so both are joined to counts, not to events."""
    by_region = (
        with_label(counts, "place", "region", REGIONS, regions, missing="Other")
        .groupBy("EventRootCode", "region", "date")
        .agg(F.sum("event_count").alias("event_count"))
    )
    return with_label(by_region, "EventRootCode", "event_description", ROOT_CODE_LABELS).select(
        "EventRootCode", "event_description", "region", "date", "event_count",
    )


def cameo_distribution(events: DataFrame, *, regions: DataFrame | None = None) -> DataFrame:
    """Events per root code, world region and publication date."""
    return cameo_from(cameo_counts(events), regions=regions)


def actor_sums(events: DataFrame) -> DataFrame:
    """Events and sums of their scores per pair of actor types."""
    return (
        events.where(F.col("Actor1Type1Code").isNotNull() & F.col("Actor2Type1Code").isNotNull())
        .groupBy(F.col("Actor1Type1Code").alias("actor1_type"), F.col("Actor2Type1Code").alias("actor2_type"))
        .agg(
            F.count("GlobalEventID").alias("event_count"),
            F.sum("GoldsteinScale").alias("goldstein_sum"),
            F.count("GoldsteinScale").alias("goldstein_n"),
            F.sum("AvgTone").alias("tone_sum"),
            F.count("AvgTone").alias("tone_n"),
        )
    )


def actor_matrix_from(sums: DataFrame) -> DataFrame:
    return sums.select(
        "actor1_type", "actor2_type", "event_count",
        F.try_divide("goldstein_sum", "goldstein_n").alias("avg_goldstein"),
        F.try_divide("tone_sum", "tone_n").alias("avg_tone"),
    )


def actor_interaction_matrix(events: DataFrame) -> DataFrame:
    """Events, mean Goldstein score and mean tone per pair of actor types."""
    return actor_matrix_from(actor_sums(events))


def religion_sums(events: DataFrame, *, conflict_quad: int = 3) -> DataFrame:
    """Conflict events and the sum of their scores per religion, country and publication date.

    The religion is the first actor's, else the second's.
    """
    believers = events.where(is_conflict(conflict_quad)).select(
        "GlobalEventID", "GoldsteinScale", F.col("ActionGeo_CountryCode").alias("place"),
        F.coalesce("Actor1Religion1Code", "Actor2Religion1Code").alias("religion"), published_date().alias("date"),
    )
    return believers.where("religion != ''").groupBy("religion", "place", "date").agg(
        F.count("GlobalEventID").alias("event_count"),
        F.sum("GoldsteinScale").alias("goldstein_sum"),
        F.count("GoldsteinScale").alias("goldstein_n"),
    )


def religion_clusters_from(sums: DataFrame, *, regions: DataFrame | None = None) -> DataFrame:
    """Events without a country count under the region ``Other``."""
    return (
        with_label(sums, "place", "region", REGIONS, regions, missing="Other")
        .groupBy("religion", "region", "date")
        .agg(
            F.sum("event_count").alias("event_count"),
            F.try_divide(F.sum("goldstein_sum"), F.sum("goldstein_n")).alias("avg_goldstein"),
        )
    )


def religion_conflict_cluster(
    events: DataFrame,
    *,
    conflict_quad: int = 3,
    regions: DataFrame | None = None,
) -> DataFrame:
    """Conflict events per religion, world region and publication date."""
    return religion_clusters_from(religion_sums(events, conflict_quad=conflict_quad), regions=regions)
