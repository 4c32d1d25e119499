"""Batch runs: a group of analyses over the landed tables."""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

from wirepulse.operators.rollups import ROLLUPS
from wirepulse.plans.registry import SHARED_COLUMNS, Analysis, in_group
from wirepulse.plans.results import done_by, note_done, record_run, write_result
from wirepulse.session import materialise, scratch_folder
from wirepulse.sources.landed import read_tables, shared_input


class RunFailed(RuntimeError):
    """Some analyses of a run failed; the others were written."""


def shared_rollups(analyses: list[Analysis], events: DataFrame | None, folder: str) -> dict[str, DataFrame]:
    """Write each rollup that at least two of the analyses read.

    A rollup holds one row per key and day, and replaces one scan of the events per
    analysis. It is written to the shared folder, so losing an executor never repeats the
    scan behind it.
    """
    readers = Counter(analysis.rollup for analysis in analyses if analysis.rollup)
    return {
        name: materialise(ROLLUPS[name](events), f"{folder}/{name}")
        for name, count in readers.items() if count > 1
    }


def result_frame(
    analysis: Analysis,
    tables: dict[str, DataFrame],
    rollups: dict[str, DataFrame],
    folder: str | None = None,
) -> DataFrame:
    """The analysis on its rollup where that was written, else on its inputs.

    An analysis with a first part has that written to ``folder``, so that its size is known
    when the rest is planned.
    """
    if analysis.rollup in rollups:
        return analysis.from_rollup(rollups[analysis.rollup])
    if analysis.first and folder:
        first = materialise(analysis.first(tables), f"{folder}/{analysis.result}")
        return analysis.from_first(first, tables)
    return analysis.run(tables)


def run_analyses(
    spark: SparkSession,
    tables: dict[str, DataFrame] | Callable[[], dict[str, DataFrame]],
    out_dir: str,
    group: str = "all",
    *,
    share: bool = True,
    cache: bool = False,
    ordered: bool = False,
    concurrent_jobs: int = 3,
    fmt: str = "parquet",
    options: dict[str, str] | None = None,
    run_id: str | None = None,
    retries: int = 0,
) -> list[str]:
    """Run a group of analyses and write each result set; returns their names.

    An analysis that fails is tried ``retries`` more times. A run with a ``run_id`` keeps a
    manifest of what it has written: started again, it does only what is left, and returns that.

    The jobs are independent, so several are submitted at once and share the cluster. A
    failing analysis does not stop the others; the run is logged either way. ``cache`` keeps
    the columns that the analyses read, for inputs that fit the cluster's memory and disks.
    ``tables`` may be a function that reads them; its failure is logged as well.
    """
    started = datetime.now(timezone.utc)
    analyses = in_group(group)
    if run_id:
        written = done_by(spark, out_dir, run_id)
        analyses = [analysis for analysis in analyses if analysis.result not in written]
    cached: dict[str, DataFrame] = {}

    def write(analysis: Analysis) -> Exception | None:
        failure = None
        for attempt in range(1 + retries):
            try:
                part = f"{folder}/{attempt}"
                frame = result_frame(analysis, read, rollups, part)
                order = analysis.order if ordered else ()
                write_result(frame, analysis.result, out_dir, fmt=fmt, sort=order, options=options, by=analysis.by)
                if run_id:
                    note_done(spark, out_dir, run_id, analysis.result)
                return None
            except Exception as error:  # noqa: BLE001  (reported below, with the run logged)
                failure = error
        return failure

    def log(failed: list[str]) -> None:
        record_run(spark, out_dir, f"{group}-{run_id or uuid.uuid4().hex}", started, datetime.now(timezone.utc), failed)

    try:
        read = tables() if callable(tables) else tables
        if cache:
            cached = {name: shared_input(read[name], columns) for name, columns in SHARED_COLUMNS.items() if name in read}
            read = read | cached
        with scratch_folder(spark, "rollups") as folder, ThreadPoolExecutor(max_workers=concurrent_jobs) as pool:
            rollups = shared_rollups(analyses, read.get("events"), folder) if share else {}
            outcome = dict(zip(analyses, pool.map(write, analyses), strict=True))
    except Exception:
        log([analysis.result for analysis in analyses])
        raise
    finally:
        for df in cached.values():
            df.unpersist()
    errors = {analysis.result: error for analysis, error in outcome.items() if error is not None}
    log(sorted(errors))
    if errors:
        name, error = next(iter(errors.items()))
        raise RunFailed(f"{len(errors)} of {len(analyses)} analyses failed, first {name}: {error}") from error
    return [analysis.result for analysis in analyses]


def run_group(
    spark: SparkSession,
    parquet_dir: str,
    out_dir: str,
    group: str = "all",
    since: datetime | None = None,
    **settings,
) -> list[str]:
    """Run a group over landed tables; ``since`` limits the scan to recent ingest partitions.

    Only the tables that the group's analyses read need to be there.
    """
    names = sorted({name for analysis in in_group(group) for name in analysis.inputs})
    return run_analyses(spark, lambda: read_tables(spark, parquet_dir, since, names), out_dir, group, **settings)
