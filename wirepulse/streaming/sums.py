"""Results kept current from a batch's own rows and sums stored before; the history is not read.

Every result is derived from a few tables of sums per key: counts, totals and co-moments, which
add up over batches. A batch's sums are written under its number, so a repeat replaces them.
Of the results by day, the days that a batch touches are replaced; where a day's rows depend on
other days, so are the days that depend on the touched ones. Totals and other results are small
beside the sums and are written whole.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType
from pyspark.storagelevel import StorageLevel

from wirepulse.functions.columns import calendar_day, published_date
from wirepulse.operators import actors, conflict, media, sentiment
from wirepulse.operators.rollups import between_countries, country_event_day, located
from wirepulse.plans.registry import ANALYSES, SHARED_COLUMNS
from wirepulse.plans.results import write_days, write_result
from wirepulse.schema import raw_schema
from wirepulse.session import file_system, materialise, scratch_folder
from wirepulse.streaming.ingest import start

#: Stored batches that are folded into one when they are so many.
FOLD_AFTER = 96
#: Touched days that become conditions of the scan of the sums.
LISTED_DAYS = 1000

COLUMNS = {**SHARED_COLUMNS, "gkg": ("DATE", "Organizations", "V2Themes", "V2Locations")}

#: Two measures of the co-moments, under the names that hold theirs.
_PAIR = {"x": "AvgTone", "y": "NumSources"}


def country_day_sums(events: DataFrame, conflict_quad: int = 3) -> DataFrame:
    """What the ``country_day`` rollup is derived from."""
    fight, paired = f"QuadClass >= {conflict_quad}", "AvgTone IS NOT NULL AND NumSources IS NOT NULL"
    moments = [f"{f}({c}) FILTER (WHERE {paired}) AS {f}_{k}" for k, c in _PAIR.items() for f in ("sum", "min", "max")]
    squares = [f"var_pop({c}) FILTER (WHERE {paired}) * count(*) FILTER (WHERE {paired}) AS sq_{k}" for k, c in _PAIR.items()]
    return (
        located(events)
        .groupBy(F.col("ActionGeo_CountryCode").alias("country"), published_date().alias("date"))
        .agg(*map(F.expr, (
            "count(GlobalEventID) AS events", "sum(AvgTone) AS tone_sum", "count(AvgTone) AS tone_n",
            f"count(*) FILTER (WHERE {fight}) AS conflict_rows",
            f"count(GlobalEventID) FILTER (WHERE {fight}) AS conflict_events",
            f"sum(GoldsteinScale) FILTER (WHERE {fight}) AS goldstein_sum",
            f"count(GoldsteinScale) FILTER (WHERE {fight}) AS goldstein_n",
            f"sum(NumMentions) FILTER (WHERE {fight}) AS mentions_sum",
            f"count(NumMentions) FILTER (WHERE {fight}) AS mentions_n",
            f"count(*) FILTER (WHERE {paired}) AS n",
            f"count(GlobalEventID) FILTER (WHERE {paired}) AS paired_events",
            *moments, *squares,
            f"covar_pop(AvgTone, NumSources) FILTER (WHERE {paired}) * count(*) FILTER (WHERE {paired}) AS co",
        )))
    )


def add_country_days(rows: DataFrame) -> DataFrame:
    """Add up; co-moments about the means of the parts become co-moments about their common mean."""
    plain = [name for name in rows.columns if name not in ("country", "date", "sq_x", "sq_y", "co") and name[:4] not in ("min_", "max_")]
    parts = F.collect_list(F.when(F.col("n") > 0, F.struct("n", "sum_x", "sum_y", "sq_x", "sq_y", "co"))).alias("_parts")
    bounds = [of(f"{name}_{k}").alias(f"{name}_{k}") for k in _PAIR for name, of in (("min", F.min), ("max", F.max))]
    # No more parts than stored batches of a key.
    added = rows.groupBy("country", "date").agg(*(F.sum(name).alias(name) for name in plain), *bounds, parts)

    def about(one: str, other: str, held: str) -> Column:
        apart = f"(p.sum_{one} / p.n - sum_{one} / n) * (p.sum_{other} / p.n - sum_{other} / n)"
        return F.expr(f"CASE WHEN n > 0 THEN aggregate(_parts, 0D, (total, p) -> total + p.{held} + p.n * {apart}) END").alias(held)

    found = added.select("*", about("x", "x", "sq_x"), about("y", "y", "sq_y"), about("x", "y", "co"))
    return found.select(*rows.columns)


def country_day_from(sums: DataFrame) -> DataFrame:
    """The rollup that A01, A02, A03, A07 and A13 read; a constant side has no correlation."""
    varied = "min_x < max_x AND min_y < max_y"
    return sums.selectExpr(
        "country", "date", "events", "try_divide(tone_sum, tone_n) AS tone", "conflict_rows", "conflict_events",
        "try_divide(goldstein_sum, goldstein_n) AS conflict_goldstein", "try_divide(mentions_sum, mentions_n) AS conflict_mentions",
        "n AS paired_rows", "paired_events", "try_divide(sum_x, n) AS paired_tone", "try_divide(sum_y, n) AS paired_sources",
        f"CASE WHEN {varied} THEN try_divide(co, sqrt(sq_x) * sqrt(sq_y)) END AS tone_sources",
    )


def pair_sums(events: DataFrame, conflict_quad: int = 3) -> DataFrame:
    """What the ``country_pair_day`` rollup is derived from."""
    fight = f"QuadClass >= {conflict_quad}"
    return (
        between_countries(events)
        .groupBy(F.col("Actor1CountryCode").alias("source"), F.col("Actor2CountryCode").alias("target"), F.col("Day").alias("date"))
        .agg(*map(F.expr, (
            "count(GlobalEventID) AS events",
            f"count(*) FILTER (WHERE QuadClass < {conflict_quad}) AS diplomatic_rows",
            f"count(*) FILTER (WHERE {fight}) AS conflict_rows",
            f"count(GlobalEventID) FILTER (WHERE {fight}) AS conflict_events",
            f"sum(GoldsteinScale) FILTER (WHERE {fight}) AS goldstein_sum",
            f"count(GoldsteinScale) FILTER (WHERE {fight}) AS goldstein_n",
        )))
    )


def pair_rollup(sums: DataFrame) -> DataFrame:
    return sums.withColumn("conflict_goldstein", F.try_divide("goldstein_sum", "goldstein_n"))


@dataclass(frozen=True)
class Sums:
    """Sums of one source's rows by ``keys``; files are kept apart by the key ``day``.

    ``add`` puts stored parts together where that is more than adding measures up.
    """

    source: str
    of: Callable[[DataFrame], DataFrame]
    keys: tuple[str, ...]
    day: str | None = None
    add: Callable[[DataFrame], DataFrame] | None = None

    def added(self, rows: DataFrame) -> DataFrame:
        if self.add:
            return self.add(rows)
        measures = [name for name in rows.columns if name not in self.keys]
        return rows.groupBy(*self.keys).agg(*(F.sum(name).alias(name) for name in measures)).select(*rows.columns)

    def schema(self, spark: SparkSession) -> StructType:
        return self.of(spark.createDataFrame([], raw_schema(self.source))).schema


def _rows(rows: DataFrame) -> DataFrame:
    return rows


SUMS: dict[str, Sums] = {
    "country_day": Sums("events", country_day_sums, ("country", "date"), "date", add_country_days),
    "country_event_day": Sums("events", country_event_day, ("country", "date"), "date"),
    "pair_day": Sums("events", pair_sums, ("source", "target", "date"), "date"),
    "cameo": Sums("events", actors.cameo_counts, ("EventRootCode", "place", "date"), "date"),
    "religion": Sums("events", actors.religion_sums, ("religion", "place", "date"), "date"),
    "ethnic": Sums("events", conflict.ethnic_sums, ("ethnicity", "date"), "date"),
    "actors": Sums("events", actors.actor_sums, ("actor1_type", "actor2_type")),
    "extremes": Sums(
        "events", lambda events: _ends(sentiment.toned_events(events)), (), None, lambda rows: _ends(rows),
    ),
    "places": Sums("events", media.event_places, (), None, _rows),
    "organizations": Sums("gkg", media.organization_counts, ("organization", "date"), "date"),
    "themes": Sums("gkg", sentiment.theme_counts, ("theme", "country_code", "year"), "year"),
    "hours": Sums("mentions", conflict.hourly_mentions, ("GlobalEventID", "mention_hour")),
    "sources": Sums("mentions", media.source_counts, ("GlobalEventID", "MentionSourceName")),
    "ticks": Sums("mentions", media.tick_counts, ("GlobalEventID", "at")),
}


def _ends(toned: DataFrame) -> DataFrame:
    """The events at both ends of the tone: all that the ends of more events can come from."""
    return sentiment.extremes_from(toned).drop("tone_extreme_type").distinct()


def trend_days(sums: DataFrame, touched: DataFrame, days: int = 3) -> DataFrame:
    """``_day``: touched days, and each country's next observed days whose moving mean looks back on one."""
    recent = Window.partitionBy("country").orderBy("date").rowsBetween(1 - days, 0)
    pairs = touched.select(F.col("country").alias("_country"), F.col("date").alias("_date"), F.lit(1).alias("_touched"))
    same = (F.col("country") == F.col("_country")) & F.col("date").eqNullSafe(F.col("_date"))
    marked = sums.select("country", "date").join(pairs, same, "left")
    return marked.withColumn("_near", F.max("_touched").over(recent)).where("_near = 1").select(F.col("date").alias("_day")).distinct()


def lag_days(_sums: DataFrame, touched: DataFrame) -> DataFrame:
    """``_day``: touched days, and the calendar days before them."""
    day = touched.select("date").distinct()
    before = F.date_format(F.date_sub(calendar_day("date"), 1), "yyyyMMdd").cast("int")
    return day.select(F.explode(F.array("date", before)).alias("_day")).distinct()


@dataclass(frozen=True)
class Derived:
    """A result made of sums. ``days`` gives the days that touched keys change, where not the touched ones alone."""

    needs: tuple[str, ...]
    frame: Callable[..., DataFrame]
    days: Callable[[DataFrame, DataFrame], DataFrame] | None = None


def _rolled(of: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    return lambda sums: of(country_day_from(sums))


DERIVED: dict[str, Derived] = {
    "conflict_heatmap": Derived(("country_day",), _rolled(conflict.heatmap_from)),
    "top_news_countries": Derived(("country_day",), _rolled(media.busiest_from)),
    "tone_source_correlation": Derived(("country_day",), _rolled(sentiment.correlation_from)),
    "sentiment_trend": Derived(("country_day",), _rolled(sentiment.trend_from), trend_days),
    "tone_conflict_lag": Derived(("country_day",), _rolled(sentiment.lag_from), lag_days),
    "media_coverage_ratio": Derived(("country_event_day",), media.coverage_from),
    "top_article_coverage": Derived(("country_event_day",), media.articles_from),
    "conflict_pairs": Derived(("pair_day",), lambda sums: conflict.pairs_from(pair_rollup(sums))),
    "diplomatic_network": Derived(("pair_day",), conflict.network_from),
    "cameo_distribution": Derived(("cameo",), actors.cameo_from),
    "religion_conflict_cluster": Derived(("religion",), actors.religion_clusters_from),
    "ethnic_conflicts": Derived(("ethnic",), conflict.ethnic_from),
    "actor_interaction_matrix": Derived(("actors",), actors.actor_matrix_from),
    "extreme_tone_events": Derived(("extremes",), sentiment.extremes_from),
    "top_organizations": Derived(("organizations",), media.organizations_from),
    "gkg_themes_continent": Derived(("themes",), sentiment.themes_from),
    "escalation_events": Derived(("hours",), conflict.escalation_from),
    "source_diversity_index": Derived(("sources", "places"), media.diversity_from),
    "breaking_news": Derived(("ticks", "places"), lambda ticks, places: media.locate_from(media.bursts_from(ticks), places)),
}


class Store:
    """Sums of batches in a folder: ``b<number>`` of one batch, ``f<number>`` of all batches before that one."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def _parts(self, name: str) -> list[tuple[str, int, str]]:
        files, pattern = file_system(self.spark, f"{self.folder}/{name}/*/_SUCCESS")
        paths = [status.getPath().getParent() for status in files.globStatus(pattern) or []]
        found = sorted((path.getName()[0], int(path.getName()[1:]), path.toString()) for path in paths)
        folds = [part for part in found if part[0] == "f"]
        upto = folds[-1][1] if folds else 0
        return [*folds[-1:], *(part for part in found if part[0] == "b" and part[1] >= upto)]

    def _write(self, rows: DataFrame, name: str, part: str) -> None:
        day = SUMS[name].day
        writer = (rows.hint("rebalance", day) if day else rows).write.mode("overwrite")
        (writer.partitionBy(day) if day else writer).parquet(f"{self.folder}/{name}/{part}")

    def _read(self, name: str, paths: list[str]) -> DataFrame:
        schema = SUMS[name].schema(self.spark)
        if not paths:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(paths[0])
        for path in paths[1:]:
            rows = rows.unionByName(self.spark.read.schema(schema).parquet(path))
        return rows.select(*schema.names)

    def put(self, name: str, rows: DataFrame, number: int) -> None:
        """Write a batch's sums, in place of what an earlier try wrote; batches count from 1, and 0 is before them."""
        self._write(SUMS[name].of(rows), name, f"b{number:010}")

    def batch(self, name: str, number: int) -> DataFrame:
        return self._read(name, [f"{self.folder}/{name}/b{number:010}"])

    def read(self, name: str, where: Callable[[DataFrame], DataFrame] = _rows) -> DataFrame:
        """All stored sums added up; ``where`` selects days before that, and so files."""
        return SUMS[name].added(where(self._read(name, [path for _, _, path in self._parts(name)])))

    def fold(self, name: str, number: int) -> None:
        """Put batches before ``number``, which no repeat can change any more, into one part if they are many."""
        older = [part for part in self._parts(name) if part[1] < number or part[0] == "f"]
        if len(older) < FOLD_AFTER:
            return
        self._write(SUMS[name].added(self._read(name, [path for _, _, path in older])), name, f"f{number:010}")
        for _, _, path in older:
            files, gone = file_system(self.spark, path)
            files.delete(gone, True)


def _of_days(day: str, days: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Selects the rows of some days (column ``_day``), which prunes files where they are not too many."""
    listed = [row["_day"] for row in days.limit(LISTED_DAYS + 1).collect()]

    def where(rows: DataFrame) -> DataFrame:
        if len(listed) <= LISTED_DAYS:
            known = F.col(day).isin([value for value in listed if value is not None])
            rows = rows.where(known | F.col(day).isNull() if None in listed else known)
        return rows.join(days, F.col(day).eqNullSafe(F.col("_day")), "left_semi")

    return where


def merge_batch(tables: dict[str, DataFrame], number: int, store: Store, out_dir: str, results: list[str] | None = None) -> None:
    """Add a batch's rows to the stored sums and bring the results up to date.

    ``tables`` has the batch's rows per source. A repeat of the last batch changes nothing.
    """
    chosen = [name for name in DERIVED if results is None or name in results]
    held = sorted({need for name in chosen for need in DERIVED[name].needs})
    fresh = [name for name in held if SUMS[name].source in tables]
    for name in fresh:
        store.fold(name, number)
        store.put(name, tables[SUMS[name].source], number)
    for name in chosen:
        if set(DERIVED[name].needs) & set(fresh):
            _derive(name, number, store, out_dir)


def _derive(name: str, number: int, store: Store, out_dir: str) -> None:
    derived, by = DERIVED[name], ANALYSES[name].by
    if by is None:
        write_result(derived.frame(*(store.read(need) for need in derived.needs)), name, out_dir)
        return
    (need,) = derived.needs
    touched = store.batch(need, number)
    with scratch_folder(store.spark, "merge") as folder:
        if derived.days is None:
            days = materialise(touched.select(F.col(by).alias("_day")).distinct(), f"{folder}/days")
            frame = derived.frame(store.read(need, _of_days(by, days)))
        else:
            days = materialise(derived.days(store.read(need), touched), f"{folder}/days")
            frame = _of_days(by, days)(derived.frame(store.read(need)))
        write_days(materialise(frame, f"{folder}/result"), name, out_dir, days, by)


def merge_results_stream(
    arrivals: dict[str, DataFrame],
    out_dir: str,
    checkpoint_dir: str,
    results: list[str] | None = None,
    *,
    history: Callable[[], dict[str, DataFrame]] | None = None,
    once: bool = False,
) -> StreamingQuery:
    """Keep result sets current as rows of the three tables land, from each batch and stored sums alone.

    ``arrivals`` streams landed tables by name, as one query, so that results of two sources see
    both. The sums live with the checkpoint, since a new one streams everything again.
    ``history`` reads rows that the stream will not bring; they are summed up once before the
    first batch. Nothing that was summed up is forgotten when landed rows expire.
    """
    spark = next(iter(arrivals.values())).sparkSession
    store = Store(spark, f"{checkpoint_dir}/sums")
    tagged = [
        rows.select(F.lit(source).alias("_source"), F.struct(*COLUMNS[source]).alias(source)) for source, rows in arrivals.items()
    ]
    stream = tagged[0]
    for more in tagged[1:]:
        stream = stream.unionByName(more, allowMissingColumns=True)

    def merge(batch: DataFrame, number: int) -> None:
        batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            if number == 0 and history:
                merge_batch(history(), 0, store, out_dir, results)
            held = [row["_source"] for row in batch.select("_source").distinct().collect()]
            tables = {source: batch.where(F.col("_source") == source).select(f"{source}.*") for source in held}
            merge_batch(tables, number + 1, store, out_dir, results)
        finally:
            batch.unpersist()

    writer = (
        stream.writeStream.foreachBatch(merge)
        .option("checkpointLocation", f"{checkpoint_dir}/merge_results")
        .queryName("merge_results")
    )
    return start(writer, once)
