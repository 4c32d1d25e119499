"""Time the nineteen analyses and the paths that users run; prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores. The raw tables are
landed once (timed apart, as ``landing``). Every query then runs once cold and
``BENCH_RUNS`` times more; the value is the sum of the warm medians. ``paths`` has one full
batch run with shared rollups, a refresh of all days by the stream, and a batch ingest cycle.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from parity.catalog import build  # noqa: E402
from parity import sample_tables  # noqa: E402
from parity.sample_tables import INGESTED_AT, landed_dir  # noqa: E402
from wirepulse.plans.batch import run_analyses  # noqa: E402
from wirepulse.plans.registry import ANALYSES, Analysis  # noqa: E402
from wirepulse.schema import landed_schema  # noqa: E402
from wirepulse.session import scratch_path  # noqa: E402
from wirepulse.sources.landed import MARKS, land_once, read_events, stamp  # noqa: E402
from wirepulse.sources.raw import parse_lines  # noqa: E402
from wirepulse.streaming.refresh import refresh_results_stream  # noqa: E402
from wirepulse.streaming.sums import Store, merge_batch  # noqa: E402


#: Results of which the merged refresh is timed.
MERGED = ["conflict_heatmap", "sentiment_trend", "actor_interaction_matrix"]


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def timed(analysis: Analysis, spark: SparkSession, sf_dir: str) -> float:
    start = time.perf_counter()
    build(analysis, spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def seconds(work: Callable[[], object]) -> float:
    start = time.perf_counter()
    work()
    return round(time.perf_counter() - start, 4)


def paths(spark: SparkSession, sf_dir: str) -> dict[str, float]:
    """Seconds of what users run, beside the single analyses."""
    tables, folder = sample_tables.tables(spark, sf_dir), scratch_path(spark, "bench")
    store = landed_dir(spark, sf_dir)
    arrivals = spark.readStream.schema(landed_schema("events")).parquet(f"{store}/events")

    def refresh() -> None:
        refresh_results_stream(
            lambda: read_events(spark, store), arrivals, f"{folder}/out", f"{folder}/checkpoint", once=True
        ).awaitTermination()

    def land() -> None:
        lines = sample_tables.raw_lines(sample_tables.news_events(spark, sf_dir), "events")
        land_once(stamp(parse_lines(lines, "events"), INGESTED_AT), spark.createDataFrame([("bench", INGESTED_AT)], MARKS), "events", f"{folder}/landed")

    merged, late = Store(spark, f"{folder}/sums"), "Day = 20240130 AND GlobalEventID % 20 = 0"
    batches = [{"events": tables["events"].where(where)} for where in (f"NOT ({late})", late)]
    return {
        "sum_up_history": seconds(lambda: merge_batch(batches[0], 1, merged, f"{folder}/merged", MERGED)),
        "merge_late_rows_of_a_day": seconds(lambda: merge_batch(batches[1], 2, merged, f"{folder}/merged", MERGED)),
        "run_all": seconds(lambda: run_analyses(spark, tables, f"{folder}/out")),
        "refresh_all_days": seconds(refresh),
        "parse_and_land_events": seconds(land),
    }


def main() -> None:
    sf_dir = os.getenv("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.getenv("BENCH_CPUS", "8")
    runs = int(os.getenv("BENCH_RUNS", "3"))
    spark = session(cpus)
    start = time.perf_counter()
    landed_dir(spark, sf_dir)
    landing = round(time.perf_counter() - start, 4)
    cold, warm = {}, {}
    for analysis in ANALYSES.values():
        name = f"{analysis.key.lower()}_{analysis.result}"
        cold[name] = round(timed(analysis, spark, sf_dir), 4)
        warm[name] = round(statistics.median(timed(analysis, spark, sf_dir) for _ in range(runs)), 4)
    print(json.dumps({
        "metric": "19 analyses, sum of warm medians",
        "value": round(sum(warm.values()), 4),
        "unit": "sec",
        "queries": warm,
        "cold": cold,
        "landing": landing,
        "paths": paths(spark, sf_dir),
        "sf": Path(sf_dir).name.removeprefix("sf"),
        "cpus": cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
