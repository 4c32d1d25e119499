"""Keep daily result sets current as events land."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from wirepulse.functions.columns import published_date
from wirepulse.plans.batch import result_frame, shared_rollups
from wirepulse.plans.registry import ANALYSES, Analysis
from wirepulse.plans.results import write_days
from wirepulse.session import materialise, scratch_folder
from wirepulse.streaming.ingest import start

#: Touched days that become conditions of the scan, and the ranges they are joined to.
LISTED_DAYS, RUNS = 1000, 30

DAY_COLUMNS = {"published": published_date, "event": lambda: F.col("Day")}


def daily_analyses() -> list[Analysis]:
    """Analyses whose rows for a day depend on that day's events alone."""
    return [analysis for analysis in ANALYSES.values() if analysis.day_of]


def _runs(days: list[int]) -> list[tuple[int, int]]:
    """Days as ``RUNS`` ranges at most, joined where the gaps are smallest."""
    runs = [(day, day) for day in sorted(days)]
    while len(runs) > RUNS:
        at = min(range(len(runs) - 1), key=lambda k: runs[k + 1][0] - runs[k][1])
        runs[at:at + 2] = [(runs[at][0], runs[at + 1][1])]
    return runs


def _stored_in(days: list, day_of: str) -> Column:
    """A condition on the stored column that holds for all rows of the days.

    Ranges, prefixes and null tests are all pushed to the Parquet scan.
    """
    plain = [day for day in days if day is not None and 10_000_000 <= day <= 99_999_999]
    found = F.lit(False)
    if day_of == "event":
        for first, last in _runs(plain):
            found = found | F.col("Day").between(first, last)
        for day in set(days) - set(plain) - {None}:
            found = found | (F.col("Day") == day)
        return found | F.col("Day").isNull() if None in days else found
    # Eight digits are the only text of that length that reads as an eight-digit number,
    # and ":" sorts after every digit.
    for first, last in _runs(plain):
        found = found | ((F.col("DATEADDED") >= str(first)) & (F.col("DATEADDED") < f"{last}:"))
    return found


def events_of_days(history: DataFrame, days: DataFrame, day_of: str) -> DataFrame:
    """All events of the given days (column ``_day``).

    Landed files follow the ingest order, so the exact days skip most of the history, years
    apart as they may be. Up to ``LISTED_DAYS`` of them become conditions on the stored
    column; with more, the semi-join decides alone. Published days that are no plain date
    come from texts of several forms, so these are looked for apart. The semi-join decides
    in any case.
    """
    day = DAY_COLUMNS[day_of]()
    listed = [row["_day"] for row in days.select("_day").distinct().limit(LISTED_DAYS + 1).collect()]
    if len(listed) > LISTED_DAYS:
        return history.join(days, day.eqNullSafe(F.col("_day")), "left_semi")
    odd = [d for d in listed if d is None or not 10_000_000 <= d <= 99_999_999]
    touched = history.where(_stored_in(listed, day_of)).join(days, day.eqNullSafe(F.col("_day")), "left_semi")
    if day_of == "event" or not odd:
        return touched
    strange = F.col("DATEADDED").isNull() | ~F.col("DATEADDED").rlike("^[1-9][0-9]{7}")
    others = days.where(F.col("_day").isNull() | ~F.col("_day").between(10_000_000, 99_999_999))
    return touched.where(day.between(10_000_000, 99_999_999)).unionByName(
        history.where(strange).join(others, day.eqNullSafe(F.col("_day")), "left_semi")
    )


def refresh_days(history: DataFrame, arrived: DataFrame, out_dir: str, analyses: list[Analysis]) -> None:
    """Recompute the touched days from the full history and replace only those days.

    Every day is recomputed whole, so replaying a batch after a failure gives the same result.
    """
    for day_of, day in DAY_COLUMNS.items():
        chosen = [analysis for analysis in analyses if analysis.day_of == day_of]
        if not chosen:
            continue
        with scratch_folder(history.sparkSession, "refresh") as folder:
            days = materialise(arrived.select(day().alias("_day")).distinct(), f"{folder}/days")
            touched = events_of_days(history, days, day_of)
            rollups = shared_rollups(chosen, touched, folder)
            for analysis in chosen:
                frame = result_frame(analysis, {"events": touched}, rollups)
                write_days(materialise(frame, f"{folder}/result-{analysis.result}"), analysis.result, out_dir, days)


def refresh_results_stream(
    history: Callable[[], DataFrame],
    arrivals: DataFrame,
    out_dir: str,
    checkpoint_dir: str,
    results: list[str] | None = None,
    *,
    once: bool = False,
) -> StreamingQuery:
    """Refresh daily result sets for each micro-batch of landed events.

    ``history`` reads the table that ``arrivals`` streams; it is called for every batch, as a
    read lists its files only once. Analyses that look across days are not refreshed here.
    """
    chosen = [a for a in daily_analyses() if results is None or a.result in results]

    def refresh(batch: DataFrame, _batch_id: int) -> None:
        refresh_days(history(), batch, out_dir, chosen)

    writer = (
        arrivals.writeStream.foreachBatch(refresh)
        .option("checkpointLocation", f"{checkpoint_dir}/refresh_results")
        .queryName("refresh_results")
    )
    return start(writer, once)
