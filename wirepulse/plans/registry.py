"""The nineteen analyses with their inputs, result keys and presentation order."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from wirepulse.operators import actors, conflict, media, sentiment

GROUPS = ("conflicts", "media", "sentiment")


@dataclass(frozen=True)
class Analysis:
    """``build`` takes the input tables in the order of ``inputs``.

    ``from_rollup`` derives the same result from a shared rollup. ``day_of`` names the day
    column of an analysis whose rows for one day depend on that day's events alone:
    ``published`` or ``event``. ``by`` is the column by which files of the result are kept
    apart, so that a part of it can be replaced. ``first`` is a part that a run writes before it plans the
    rest, ``from_first``.
    """

    key: str
    result: str
    group: str
    inputs: tuple[str, ...]
    build: Callable[..., DataFrame]
    order: tuple[str, ...]
    rollup: str | None = None
    from_rollup: Callable[[DataFrame], DataFrame] | None = None
    day_of: str | None = None
    by: str | None = None
    first: Callable[[dict[str, DataFrame]], DataFrame] | None = None
    from_first: Callable[[DataFrame, dict[str, DataFrame]], DataFrame] | None = None

    def __post_init__(self) -> None:
        if self.day_of and not self.by:
            object.__setattr__(self, "by", "date")

    def run(self, tables: dict[str, DataFrame]) -> DataFrame:
        return self.build(*[tables[name] for name in self.inputs])


_EVENTS = ("events",)

ANALYSES: dict[str, Analysis] = {
    analysis.result: analysis
    for analysis in (
        Analysis("A01", "conflict_heatmap", "conflicts", _EVENTS, conflict.conflict_heatmap,
                 ("date", "avg_goldstein"), "country_day", conflict.heatmap_from, "published"),
        Analysis("A02", "top_news_countries", "media", _EVENTS, media.top_news_countries,
                 ("date", "rank"), "country_day", media.busiest_from, "published"),
        Analysis("A03", "tone_source_correlation", "sentiment", _EVENTS, sentiment.tone_source_correlation,
                 ("-sample_size",), "country_day", sentiment.correlation_from, "published"),
        Analysis("A04", "cameo_distribution", "sentiment", _EVENTS, actors.cameo_distribution,
                 ("date", "region", "-event_count"), day_of="published"),
        Analysis("A05", "actor_interaction_matrix", "sentiment", _EVENTS, actors.actor_interaction_matrix,
                 ("-event_count",)),
        Analysis("A06", "media_coverage_ratio", "media", _EVENTS, media.media_coverage_ratio,
                 ("-mentions_per_event",), "country_event_day", media.coverage_from, "event"),
        Analysis("A07", "sentiment_trend", "sentiment", _EVENTS, sentiment.sentiment_trend,
                 ("country", "date"), "country_day", sentiment.trend_from, by="date"),
        Analysis("A08", "conflict_pairs", "conflicts", _EVENTS, conflict.conflict_pairs,
                 ("-conflict_count",), "country_pair_day", conflict.pairs_from, "event"),
        Analysis("A09", "escalation_events", "conflicts", ("mentions",), conflict.escalation_events,
                 ("-escalation_ratio",)),
        Analysis("A10", "religion_conflict_cluster", "sentiment", _EVENTS, actors.religion_conflict_cluster,
                 ("-event_count",), day_of="published"),
        Analysis("A11", "gkg_themes_continent", "sentiment", ("gkg",), sentiment.gkg_themes_continent,
                 ("continent", "year", "rank"), by="year"),
        Analysis("A12", "top_organizations", "media", ("gkg",), media.top_organizations,
                 ("date", "rank"), by="date"),
        Analysis("A13", "tone_conflict_lag", "sentiment", _EVENTS, sentiment.tone_conflict_lag,
                 ("country", "date"), "country_day", sentiment.lag_from, by="date"),
        Analysis("A14", "diplomatic_network", "conflicts", _EVENTS, conflict.diplomatic_network,
                 ("-total_interactions",), "country_pair_day", conflict.network_from),
        Analysis("A15", "source_diversity_index", "media", ("mentions", "events"), media.source_diversity_index,
                 ("-source_diversity_index",)),
        Analysis("A16", "ethnic_conflicts", "conflicts", _EVENTS, conflict.ethnic_conflicts,
                 ("-event_count",), day_of="event"),
        Analysis("A17", "breaking_news", "media", ("mentions", "events"), media.breaking_news,
                 ("-mentions_in_first_hour",),
                 first=lambda tables: media.first_hour_bursts(tables["mentions"]),
                 from_first=lambda bursts, tables: media.locate_bursts(bursts, tables["events"])),
        Analysis("A18", "extreme_tone_events", "sentiment", _EVENTS, sentiment.extreme_tone_events,
                 ("-tone_extreme_type", "AvgTone")),
        Analysis("A19", "top_article_coverage", "sentiment", _EVENTS, media.top_article_coverage,
                 ("-total_articles",), "country_event_day", media.articles_from),
    )
}


# Columns that the analyses read, of inputs that more than one of them scans.
SHARED_COLUMNS = {
    "events": (
        "GlobalEventID", "Day", "DATEADDED", "ActionGeo_CountryCode", "ActionGeo_FullName",
        "Actor1CountryCode", "Actor2CountryCode", "Actor1Type1Code", "Actor2Type1Code",
        "Actor1EthnicCode", "Actor2EthnicCode", "Actor1Religion1Code", "Actor2Religion1Code",
        "EventRootCode", "QuadClass", "GoldsteinScale", "AvgTone", "NumMentions", "NumSources", "NumArticles",
    ),
    "mentions": ("GlobalEventID", "MentionTimeDate", "MentionSourceName"),
}


def in_group(group: str) -> list[Analysis]:
    """Analyses of one group, or of all of them."""
    if group == "all":
        return list(ANALYSES.values())
    if group not in GROUPS:
        raise ValueError(f"unknown group {group!r}; expected 'all' or one of {GROUPS}")
    return [analysis for analysis in ANALYSES.values() if analysis.group == group]
