"""Serving views: the slices of the result sets that readers page through.

A view is filter, order, limit and projection over one result set. Orders on non-unique
keys end with the result set's key columns, so a cut is the same on every run.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

API_LIMIT = 200
DEFAULT_LIMIT = 500


def ordering(sort: Sequence[str]) -> list[Column]:
    return [F.desc(name[1:]) if name.startswith("-") else F.asc(name) for name in sort]


def top_view(
    df: DataFrame,
    sort: Sequence[str] = (),
    limit: int | None = DEFAULT_LIMIT,
    where: Column | str | None = None,
    cols: Sequence[str] | None = None,
) -> DataFrame:
    """Filter, order (``-name`` descends), cut and project a result set."""
    out = df if where is None else df.where(where)
    if sort:
        out = out.orderBy(*ordering(sort))
    if limit:
        out = out.limit(limit)
    return out.select(*cols) if cols else out


@dataclass(frozen=True)
class View:
    """Page slice of a result set, and the shorter panel shown from that slice."""

    key: str
    result: str
    sort: tuple[str, ...]
    limit: int
    panel: Callable[[DataFrame, tuple[str, ...]], DataFrame]

    def page(self, df: DataFrame) -> DataFrame:
        return top_view(df, self.sort, self.limit)

    def shown(self, df: DataFrame) -> DataFrame:
        return self.panel(self.page(df), self.sort)


def first_rows(n: int) -> Callable[[DataFrame, tuple[str, ...]], DataFrame]:
    return lambda page, sort: top_view(page, sort, n)


def severity_bands(page: DataFrame, sort: tuple[str, ...]) -> DataFrame:
    """First 20 rows, banded at a mean Goldstein score of -3 and 3."""
    score = F.col("avg_goldstein")
    band = F.when(score < -3, "severe").when(score > 3, "cooperative").otherwise("neutral")
    return top_view(page, sort, 20).withColumn("severity", band)


def daily_leaders(page: DataFrame, sort: tuple[str, ...]) -> DataFrame:
    """The leading country of the last 14 days on the page."""
    return top_view(page, sort, 14, where="rank = 1")


def strong_correlations(page: DataFrame, sort: tuple[str, ...]) -> DataFrame:
    """First 15 rows, flagged where the correlation exceeds 0.5."""
    strong = F.coalesce(F.col("tone_sources_correlation") > 0.5, F.lit(False))
    return top_view(page, sort, 15).withColumn("strong", strong)


def region_totals(page: DataFrame, sort: tuple[str, ...]) -> DataFrame:
    """Events on the page summed by region, the eight largest."""
    totals = page.groupBy(F.coalesce("region", F.lit("Other")).alias("region")).agg(
        F.sum("event_count").alias("event_count")
    )
    return top_view(totals, ("-event_count", "region"), 8)


def recent_trends(page: DataFrame, sort: tuple[str, ...]) -> DataFrame:
    """Last 30 days of the first three countries on the page."""
    newest_first = Window.partitionBy("country").orderBy(F.desc("date"))
    return (
        page.withColumn("_place", F.dense_rank().over(Window.orderBy("country")))
        .where("_place <= 3")
        .withColumn("_age", F.row_number().over(newest_first))
        .where("_age <= 30")
        .drop("_place", "_age")
    )


def signed_bands(page: DataFrame, sort: tuple[str, ...]) -> DataFrame:
    """First 15 rows with the sign of their mean Goldstein score."""
    sign = F.when(F.col("avg_goldstein") < 0, "hostile").otherwise("favourable")
    return top_view(page, sort, 15).withColumn("sign", sign)


def named_groups(page: DataFrame, sort: tuple[str, ...]) -> DataFrame:
    """First 10 ethnic groups, unnamed ones shown as N/A."""
    return top_view(page, sort, 10).withColumn("ethnicity", F.coalesce("ethnicity", F.lit("N/A")))


def placed_bursts(page: DataFrame, sort: tuple[str, ...]) -> DataFrame:
    """First 10 bursts, those without a known country shown as N/A."""
    return top_view(page, sort, 10).withColumn("country", F.coalesce("country", F.lit("N/A")))


VIEWS: dict[str, View] = {
    view.key: view
    for view in (
        View("V01", "conflict_heatmap", ("-date", "country"), 200, severity_bands),
        View("V02", "top_news_countries", ("-date", "rank", "country"), 100, daily_leaders),
        View("V03", "tone_source_correlation", ("-date", "country"), 100, strong_correlations),
        View("V04", "cameo_distribution", ("-date", "-event_count", "EventRootCode", "region"), 200, region_totals),
        View("V05", "actor_interaction_matrix", ("-event_count", "actor1_type", "actor2_type"), 100, first_rows(20)),
        View("V06", "media_coverage_ratio", ("-mentions_per_event", "country", "date"), 50, first_rows(15)),
        View("V07", "sentiment_trend", ("country", "date"), 2000, recent_trends),
        View("V08", "conflict_pairs", ("-conflict_count", "actor1_country", "actor2_country", "date"), 50, first_rows(15)),
        View("V09", "escalation_events", ("-escalation_ratio", "GlobalEventID", "mention_hour"), 30, first_rows(10)),
        View("V10", "religion_conflict_cluster", ("-event_count", "religion", "region", "date"), 50, signed_bands),
        View("V11", "gkg_themes_continent", ("-year", "continent", "rank", "theme"), 200, first_rows(20)),
        View("V12", "top_organizations", ("-date", "rank", "organization"), 100, first_rows(15)),
        View("V13", "tone_conflict_lag", ("-date", "country"), 200, first_rows(12)),
        View("V14", "diplomatic_network", ("-total_interactions", "source_country", "target_country"), 50, first_rows(12)),
        View("V15", "source_diversity_index", ("-source_diversity_index", "country", "date"), 50, first_rows(12)),
        View("V16", "ethnic_conflicts", ("-event_count", "ethnicity", "date"), 30, named_groups),
        View("V17", "breaking_news", ("-first_mention_time", "GlobalEventID"), 30, placed_bursts),
        View("V18", "extreme_tone_events", ("AvgTone", "GlobalEventID", "tone_extreme_type"), 30, first_rows(20)),
        View("V19", "top_article_coverage", ("-total_articles", "country"), 50, first_rows(15)),
    )
}


def json_rows(df: DataFrame, limit: int = API_LIMIT) -> DataFrame:
    """Up to ``limit`` rows of a result set as JSON text."""
    return df.limit(limit).select(F.to_json(F.struct(*df.columns)).alias("document"))


def row_counts(results: dict[str, DataFrame]) -> DataFrame:
    """Number of rows of each result set."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("result_set"), "row_count")
        for name, df in results.items()
    ]
    out = counts[0]
    for one in counts[1:]:
        out = out.unionByName(one)
    return out


def table_json(results: dict[str, DataFrame], name: str, limit: int = API_LIMIT) -> DataFrame:
    """JSON rows of one of the known result sets; any other name is refused."""
    from wirepulse.plans.registry import ANALYSES

    if name not in ANALYSES or name not in results:
        raise KeyError(f"no result set {name!r}")
    return json_rows(results[name], limit)
