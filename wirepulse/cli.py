"""Command line: ``python -m wirepulse run|ingest|expire|stream`` (also under spark-submit)."""

from __future__ import annotations

import argparse
import os
from collections.abc import Sequence
from datetime import datetime, timezone

from wirepulse.plans.registry import GROUPS
from wirepulse.schema import RAW_SCHEMAS, landed_schema


def build_parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="wirepulse", description="News-event analytics on Spark")
    commands = parser.add_subparsers(dest="command", required=True)

    run = commands.add_parser("run", help="run a group of analyses over landed tables")
    run.add_argument("--group", choices=("all", *GROUPS), default="all")
    run.add_argument("--in", "--parquet-dir", dest="parquet_dir", default=os.getenv("PARQUET_INPUT_DIR", "/data/parquet"))
    run.add_argument("--out", dest="out_dir", required=True)
    run.add_argument("--since", type=datetime.fromisoformat, help="only rows ingested since then (UTC)")
    run.add_argument("--format", dest="fmt", default="parquet")
    run.add_argument("--option", action="append", default=[], metavar="KEY=VALUE", help="writer option")
    run.add_argument("--ordered", action="store_true", help="write rows in presentation order")
    run.add_argument("--cache", action="store_true", help="keep the shared input columns in memory or on disk")
    run.add_argument("--run-id", help="name of the run; started again under it, only what is left is done")
    run.add_argument("--retries", type=int, default=0, help="further tries of an analysis that fails")
    run.add_argument("--jobs", type=int, default=3, help="analyses submitted at once")

    ingest = commands.add_parser("ingest", help="land raw files and expire old rows")
    ingest.add_argument("--raw", dest="raw_dir", required=True)
    ingest.add_argument("--out", dest="out_dir", default=os.getenv("PARQUET_OUTPUT_DIR", "/data/parquet"))
    ingest.add_argument("--retention-hours", type=int, default=int(os.getenv("RAW_RETENTION_HOURS", "1")))
    ingest.add_argument("--compact", action="store_true", help="even out file sizes by a shuffle")

    expire = commands.add_parser("expire", help="remove landed rows past the retention")
    expire.add_argument("--out", dest="out_dir", default=os.getenv("PARQUET_OUTPUT_DIR", "/data/parquet"))
    expire.add_argument("--retention-hours", type=int, default=int(os.getenv("RAW_RETENTION_HOURS", "1")))

    stream = commands.add_parser("stream", help="run one streaming job until it is stopped")
    stream.add_argument("job", choices=sorted(STREAMS))
    stream.add_argument("--raw", dest="raw_dir", help="raw files (ingest)")
    stream.add_argument("--tables", dest="table_dir", default=os.getenv("PARQUET_OUTPUT_DIR", "/data/parquet"))
    stream.add_argument("--out", dest="out_dir", help="results (all jobs but ingest)")
    stream.add_argument("--checkpoint", dest="checkpoint_dir", required=True)
    stream.add_argument("--retention-hours", type=int, default=int(os.getenv("RAW_RETENTION_HOURS", "1")),
                        help="how long landed rows are kept (ingest) and repeated event ids are known")
    stream.add_argument("--forget-hours", type=int, default=7 * 24, help="how long the detectors remember an event")
    stream.add_argument("--once", action="store_true", help="process what is there and stop")
    return parser


def _landed_stream(spark, args, table: str):
    return spark.readStream.schema(landed_schema(table)).parquet(f"{args.table_dir}/{table}")


def _stream_ingest(spark, args) -> list:
    from wirepulse.streaming.ingest import ingest_stream

    return [
        ingest_stream(spark, args.raw_dir, args.table_dir, args.checkpoint_dir, table,
                      within=f"{args.retention_hours} hours", retention_hours=args.retention_hours, once=args.once)
        for table in RAW_SCHEMAS
    ]


def _stream_escalation(spark, args) -> list:
    from wirepulse.streaming.detectors import run_escalation

    mentions = _landed_stream(spark, args, "mentions")
    forget = args.forget_hours * 3600
    return run_escalation(spark, mentions, args.out_dir, args.checkpoint_dir, once=args.once, forget_seconds=forget)


def _stream_breaking(spark, args) -> list:
    from wirepulse.streaming.detectors import run_breaking

    mentions = _landed_stream(spark, args, "mentions")
    forget = args.forget_hours * 3600
    return run_breaking(spark, mentions, args.out_dir, args.checkpoint_dir, once=args.once, forget_seconds=forget)


def _stream_refresh(spark, args) -> list:
    from wirepulse.streaming.sums import merge_results_stream

    arrivals = {table: _landed_stream(spark, args, table) for table in RAW_SCHEMAS}
    return [merge_results_stream(arrivals, args.out_dir, args.checkpoint_dir, once=args.once)]


STREAMS = {
    "ingest": _stream_ingest,
    "escalation": _stream_escalation,
    "breaking": _stream_breaking,
    "refresh": _stream_refresh,
}


def main(argv: Sequence[str] | None = None) -> int:
    from wirepulse.plans.batch import run_group
    from wirepulse.session import create_session
    from wirepulse.sources.landed import expire, ingest

    args = build_parser().parse_args(argv)
    spark = create_session(f"wirepulse-{args.command}")
    now = datetime.now(timezone.utc)
    if args.command == "run":
        options = dict(item.split("=", 1) for item in args.option)
        written = run_group(
            spark, args.parquet_dir, args.out_dir, args.group, args.since,
            ordered=args.ordered, cache=args.cache, concurrent_jobs=args.jobs, fmt=args.fmt, options=options,
            run_id=args.run_id, retries=args.retries,
        )
        print("\n".join(written))
    elif args.command == "ingest":
        ingest(spark, args.raw_dir, args.out_dir, now, args.retention_hours, args.compact)
    elif args.command == "stream":
        for query in STREAMS[args.job](spark, args):
            query.awaitTermination()
    else:
        for table in RAW_SCHEMAS:
            expire(spark, args.out_dir, table, now, args.retention_hours)
    return 0
