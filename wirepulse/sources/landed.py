"""Landed Parquet tables: landings, scan, retention and pruned caching.

A table is a folder of landings, each a partition ``landing=<id>`` that holds its rows by
ingest hour and, out of sight of table scans, the marks of where they come from. Spark
writes a landing as a hidden folder and one rename shows it, rows and marks at once. So
nothing is ever seen in part, by batch or by stream, and writers do not meet.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from wirepulse.schema import LANDING, PARTITION_COLUMNS, RAW_SCHEMAS, landed_schema
from wirepulse.session import file_system
from wirepulse.sources.raw import (
    REJECT_COLUMNS,
    file_pattern,
    parse_lines,
    raw_files,
    read_lines,
    refuse_archives,
    rejected_lines,
)

#: Within a table: landings under way, and the marks of each landing.
PENDING, MARKED = "_pending", "_marks"
#: Beside the tables: marks of landings whose rows are gone, retention bounds, refused lines, one
#: row per landing, and who runs a cycle.
LEDGER, BOUNDS, REJECTS, INGEST_LOG, LEASES = "_ledger", "_bounds", "_rejects", "_ingest_log", "_leases"
MARKS = "path string, modified timestamp"
BOUND_SCHEMA = "bound timestamp, at timestamp"
INGEST_LOG_SCHEMA = "table string, at timestamp, files long, lines long, over_long long"

#: A cycle, or a landing under way, that is older than this was broken off.
ABANDONED = timedelta(hours=6)


def utc(moment: datetime) -> datetime:
    """A time without zone counts as UTC."""
    return moment.replace(tzinfo=timezone.utc) if moment.tzinfo is None else moment.astimezone(timezone.utc)


def _instant(moment: datetime) -> Column:
    micros = (utc(moment) - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)
    return F.timestamp_micros(F.lit(micros))


def stamp(df: DataFrame, ingested_at: datetime) -> DataFrame:
    """Add the ingest time and the partition columns derived from it, in UTC."""
    moment = utc(ingested_at)
    return df.select(
        "*",
        _instant(moment).alias("ingest_ts"),
        F.lit(moment.date()).alias("ingest_date"),
        F.lit(moment.hour).alias("ingest_hour"),
    )


def land(df: DataFrame, table: str, out_dir: str, ingested_at: datetime, compact: bool = False) -> None:
    """Append rows to a landed table.

    Without ``compact`` every task writes one file and nothing is shuffled. ``compact``
    evens out file sizes by a rebalancing shuffle, for cycles of many small raw files.
    """
    stamped = stamp(df, ingested_at)
    land_once(stamped.hint("rebalance") if compact else stamped, None, table, out_dir)


def distinct_events(df: DataFrame) -> DataFrame:
    """One row per event id; rows without an id are all kept.

    De-duplication aggregates before it shuffles, so copies of one id leave each task as
    a single row.
    """
    unnamed = F.when(F.col("GlobalEventID").isNull(), F.uuid())
    return df.withColumn("_unnamed", unnamed).dropDuplicates(["GlobalEventID", "_unnamed"]).drop("_unnamed")


def unseen_events(rows: DataFrame, landed_rows: DataFrame) -> DataFrame:
    """Events whose id is not among the landed ones; rows without an id are all kept."""
    return rows.join(landed_rows.select("GlobalEventID"), "GlobalEventID", "left_anti")


def read_table(
    spark: SparkSession,
    parquet_dir: str,
    table: str,
    since: datetime | None = None,
) -> DataFrame:
    """Scan a landed table with its declared schema, without rows past the retention.

    ``since`` and the retention bound prune whole partitions.
    """
    df = spark.read.schema(landed_schema(table)).parquet(f"{parquet_dir}/{table}")
    bound = retention_bound(spark, parquet_dir, table)
    for limit in (since, bound):
        df = df if limit is None else df.where(ingested_since(limit))
    return df


def read_events(spark: SparkSession, parquet_dir: str, since: datetime | None = None) -> DataFrame:
    return read_table(spark, parquet_dir, "events", since)


def read_mentions(spark: SparkSession, parquet_dir: str, since: datetime | None = None) -> DataFrame:
    return read_table(spark, parquet_dir, "mentions", since)


def read_gkg(spark: SparkSession, parquet_dir: str, since: datetime | None = None) -> DataFrame:
    return read_table(spark, parquet_dir, "gkg", since)


def read_tables(
    spark: SparkSession,
    parquet_dir: str,
    since: datetime | None = None,
    names: Iterable[str] = tuple(RAW_SCHEMAS),
) -> dict[str, DataFrame]:
    return {table: read_table(spark, parquet_dir, table, since) for table in names}


def shared_input(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Keep only ``columns`` of an input that several analyses read in memory or on disk.

    Caching a whole input would scan all its columns and push no filter down.
    """
    return df.select(*columns).persist(StorageLevel.MEMORY_AND_DISK)


def ingested_since(cutoff: datetime) -> Column:
    """Exact ingest-time bound, with a bound on the partition columns that prunes files."""
    moment = utc(cutoff)
    day = F.lit(moment.date())
    partition = (F.col("ingest_date") > day) | (
        (F.col("ingest_date") == day) & (F.col("ingest_hour") >= moment.hour)
    )
    return partition & (F.col("ingest_ts") >= _instant(moment))


def retain(df: DataFrame, now: datetime, hours: int = 1) -> DataFrame:
    """Rows ingested in the last ``hours`` hours."""
    return df.where(ingested_since(utc(now) - timedelta(hours=hours)))


def retention_bound(spark: SparkSession, parquet_dir: str, table: str, at: datetime | None = None) -> datetime | None:
    """The ingest time before which rows are past the retention, as it was set until ``at``."""
    folder = f"{parquet_dir}/{BOUNDS}/{table}"
    if not _has_files(spark, folder):
        return None
    bounds = spark.read.schema(BOUND_SCHEMA).parquet(folder)
    if at is not None:
        bounds = bounds.where(F.col("at") <= _instant(at))
    micros = bounds.agg(F.max(F.unix_micros("bound")).alias("bound")).first()["bound"]
    return None if micros is None else datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=micros)


def expire(
    spark: SparkSession, parquet_dir: str, table: str, now: datetime, hours: int = 1, grace: timedelta = timedelta(0)
) -> int:
    """Set the retention of a landed table to ``hours`` and delete what went past it; returns dropped partitions.

    Readers that start from now on leave out older rows at once. Files go only when a bound
    has left them out for ``grace``: give the time of the longest query, and one that was
    planned before ends undisturbed. Only whole partitions are deleted and none is
    rewritten; rows of the one that a bound falls into are left out by readers until then.
    """
    _append(spark.createDataFrame([(utc(now) - timedelta(hours=hours), utc(now))], BOUND_SCHEMA), f"{parquet_dir}/{BOUNDS}/{table}")
    bound = retention_bound(spark, parquet_dir, table, utc(now) - grace)
    if bound is None:
        return 0
    boundary = (F.col("ingest_date") == F.lit(bound.date())) & (F.col("ingest_hour") == bound.hour)
    rows = spark.read.schema(landed_schema(table)).parquet(f"{parquet_dir}/{table}").where(boundary)
    passed = rows.groupBy("landing").agg(F.bool_and(F.col("ingest_ts") < _instant(bound)).alias("all")).where("all")
    edge = {row["landing"] for row in passed.collect()}
    dropped = 0
    files, pattern = file_system(spark, f"{parquet_dir}/{table}/landing=*/ingest_date=*/ingest_hour=*")
    for status in files.globStatus(pattern) or []:
        path = status.getPath()
        hour, day, landing = (p.getName().split("=", 1)[1] for p in (path, path.getParent(), path.getParent().getParent()))
        place = (day, int(hour))
        limit = (bound.date().isoformat(), bound.hour)
        if place < limit or (place == limit and landing in edge):
            files.delete(path, True)
            dropped += 1
    return dropped


def _append(df: DataFrame, folder: str) -> None:
    df.coalesce(1).write.mode("append").parquet(folder)


def _has_files(spark: SparkSession, pattern: str) -> bool:
    files, path = file_system(spark, pattern)
    return bool(files.globStatus(path))


def landed_marks(spark: SparkSession, out_dir: str, table: str) -> DataFrame:
    """``path, modified`` of what was landed before: raw files, or batches of a stream."""
    folders = [f"{out_dir}/{table}/landing=*/{MARKED}", *_ledger(spark, out_dir, table)]
    folders = [folder for folder in folders if _has_files(spark, folder)]
    return spark.read.schema(MARKS).parquet(*folders) if folders else spark.createDataFrame([], MARKS)


def _ledger(spark: SparkSession, out_dir: str, table: str) -> list[str]:
    """The newest whole edition of the marks that outlived their landings."""
    files, pattern = file_system(spark, f"{out_dir}/{LEDGER}/{table}/edition-*/_SUCCESS")
    found = sorted(status.getPath().getParent().toString() for status in files.globStatus(pattern) or [])
    return found[-1:]


def sweep(spark: SparkSession, raw_dir: str, out_dir: str, table: str, now: datetime) -> int:
    """Clear what landings leave behind; returns how many were cleared.

    A landing without rows goes, its marks to a new edition of the ledger; the ledger keeps
    only marks of files that are still in the raw folder. A stream's last landing stays, as
    the stream may ask for it again. Landings under way that are older than ``ABANDONED`` go
    as well. A reader of the marks meets each at least once.
    """
    files, pattern = file_system(spark, f"{out_dir}/{table}/landing=*")
    landings = list(files.globStatus(pattern) or [])
    newest: dict[str, int] = {}
    for status in landings:
        stream, _, number = status.getPath().getName().split("=", 1)[1].rpartition("-")
        newest[stream] = max(int(number), newest.get(stream, 0)) if stream else 0
    emptied = []
    for status in landings:
        stream, _, number = status.getPath().getName().split("=", 1)[1].rpartition("-")
        if stream and int(number) == newest[stream]:
            continue
        names = [child.getPath() for child in files.listStatus(status.getPath())]
        days = [name for name in names if name.getName().startswith("ingest_date=")]
        if not any(len(files.listStatus(day)) for day in days):
            emptied.append(status.getPath())
    if emptied:
        before = _ledger(spark, out_dir, table)
        held = [f"{path}/{MARKED}" for path in emptied if files.exists(file_system(spark, f"{path}/{MARKED}")[1])]
        listed = raw_files(spark, raw_dir, table) if _has_files(spark, f"{raw_dir}/{file_pattern(table)}") else None
        if held or before:
            marks = spark.read.schema(MARKS).parquet(*held, *before)
            marks = marks.join(listed, ["path", "modified"], "left_semi") if listed is not None else marks.limit(0)
            edition = f"{out_dir}/{LEDGER}/{table}/edition-{utc(now):%Y%m%d%H%M%S}-{uuid.uuid4().hex}"
            marks.distinct().coalesce(1).write.parquet(edition)
        for path in (*emptied, *(file_system(spark, folder)[1] for folder in before)):
            files.delete(path, True)
    oldest = (utc(now) - ABANDONED).timestamp() * 1000
    _, pattern = file_system(spark, f"{out_dir}/{table}/{PENDING}/*")
    for status in files.globStatus(pattern) or []:
        if status.getModificationTime() < oldest:
            files.delete(status.getPath(), True)
    return len(emptied)


def is_landed(spark: SparkSession, table: str, out_dir: str, landing: str) -> bool:
    return _has_files(spark, f"{out_dir}/{table}/{LANDING}={landing}")


def land_once(stamped: DataFrame, marks: DataFrame | None, table: str, out_dir: str, landing: str | None = None) -> bool:
    """Land rows together with the marks of where they come from, all or nothing; whether they were landed now.

    ``stamped`` has the ingest time and partition columns. A landing that was named before
    is not landed again; one that broke off before it was shown is written anew.
    """
    spark = stamped.sparkSession
    landing = landing or f"l{uuid.uuid4().hex}"
    if is_landed(spark, table, out_dir, landing):
        return False
    pending = f"{out_dir}/{table}/{PENDING}/{landing}"
    rows = stamped.drop(LANDING) if LANDING in stamped.columns else stamped
    rows.write.mode("overwrite").partitionBy(*PARTITION_COLUMNS).option("compression", "snappy").parquet(pending)
    if marks is not None:
        marks.select("path", "modified").coalesce(1).write.parquet(f"{pending}/{MARKED}")
    _show(spark, pending, f"{out_dir}/{table}/{LANDING}={landing}")
    return True


def _show(spark: SparkSession, pending: str, place: str) -> None:
    """Rename a written landing to its place, which makes it part of the table."""
    files, source = file_system(spark, pending)
    if not files.rename(source, file_system(spark, place)[1]):
        raise OSError(f"cannot show {pending} as {place}")


class CycleRunning(RuntimeError):
    """Another cycle lands files into the table."""


@contextmanager
def cycle_lease(spark: SparkSession, out_dir: str, table: str, now: datetime) -> Iterator[None]:
    """Let one cycle at a time look for new files of a table.

    Two of them would both find a file new. The one that comes second raises
    ``CycleRunning``; the files are left to the first or to the next cycle.
    """
    files, path = file_system(spark, f"{out_dir}/{LEASES}/{table}")
    files.mkdirs(path.getParent())
    if files.exists(path) and files.getFileStatus(path).getModificationTime() < (datetime.now(timezone.utc) - ABANDONED).timestamp() * 1000:
        files.delete(path, False)
    if not files.createNewFile(path):
        raise CycleRunning(f"another cycle lands {table} into {out_dir}")
    try:
        yield
    finally:
        files.delete(path, False)


def ingest(
    spark: SparkSession,
    raw_dir: str,
    out_dir: str,
    now: datetime,
    retention_hours: int | None = 1,
    compact: bool = False,
    dedup_hours: int | None = None,
    grace: timedelta = timedelta(0),
) -> dict[str, int]:
    """One ingest cycle: parse, coerce, de-duplicate events, land new files and expire each table.

    Only files that the ledger does not name, by path and modification time, are read.
    Events are dropped when their id came twice in this cycle or was landed in the last
    ``dedup_hours`` hours, by default as long as rows are kept. Refused lines go to a table
    of their own, and the ingest log counts them. Where another cycle lands a table, its
    files are left to that one. Returns the number of expired partitions per table; tables
    without new files are expired too.
    """
    dropped = {}
    dedup_hours = retention_hours if dedup_hours is None else dedup_hours
    for table in RAW_SCHEMAS:
        dropped[table] = 0
        try:
            with cycle_lease(spark, out_dir, table, now):
                if _has_files(spark, f"{raw_dir}/{file_pattern(table)}"):
                    _land_new_files(spark, raw_dir, out_dir, table, now, compact, dedup_hours)
                if retention_hours and _has_files(spark, f"{out_dir}/{table}"):
                    dropped[table] = expire(spark, out_dir, table, now, retention_hours, grace)
                    sweep(spark, raw_dir, out_dir, table, now)
        except CycleRunning:
            continue
    return dropped


def rejects(spark: SparkSession, out_dir: str, table: str) -> DataFrame:
    """``file, line, reason`` of the lines of a table that no landing took."""
    folder = f"{out_dir}/{REJECTS}/{table}"
    if not _has_files(spark, folder):
        return spark.createDataFrame([], f"{REJECT_COLUMNS}, landing string")
    return spark.read.schema(f"{REJECT_COLUMNS}, landing string").parquet(folder)


def _land_new_files(
    spark: SparkSession, raw_dir: str, out_dir: str, table: str, now: datetime, compact: bool, dedup_hours: int | None
) -> None:
    found = raw_files(spark, raw_dir, table)
    refuse_archives(found)
    fresh = found.join(landed_marks(spark, out_dir, table), ["path", "modified"], "left_anti")
    fresh = fresh.select("path", "modified").collect()
    if not fresh:
        return
    landing = f"l{uuid.uuid4().hex}"
    counted = Observation()
    width = len(RAW_SCHEMAS[table])
    paths = [row["path"] for row in fresh]
    lines = read_lines(spark, paths, table).observe(
        counted, F.count_if(F.size(F.split("value", "\t", -1)) > width).alias("over_long"), F.count(F.lit(1)).alias("lines"),
        F.count_if(F.col("value") == "").alias("blank"),
    )
    rows = parse_lines(lines, table)
    if table == "events":
        rows = distinct_events(rows)
        if _has_files(spark, f"{out_dir}/events"):
            since = utc(now) - timedelta(hours=dedup_hours) if dedup_hours else None
            rows = unseen_events(rows, read_events(spark, out_dir, since))
    stamped = stamp(rows, now)
    land_once(stamped.hint("rebalance") if compact else stamped, spark.createDataFrame(fresh, MARKS), table, out_dir, landing)
    seen = counted.get
    if seen["over_long"] + seen["blank"]:
        # Few cycles have any, so the lines are read again only then.
        refused = rejected_lines(read_lines(spark, paths, table), table)
        refused.write.mode("overwrite").parquet(f"{out_dir}/{REJECTS}/{table}/{LANDING}={landing}")
    row = (table, utc(now), len(fresh), seen["lines"], seen["over_long"])
    _append(spark.createDataFrame([row], INGEST_LOG_SCHEMA), f"{out_dir}/{INGEST_LOG}")
