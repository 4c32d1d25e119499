"""Continuous ingestion of raw files."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from wirepulse.sources.landed import MARKS, expire, is_landed, land_once
from wirepulse.sources.raw import parse_lines, raw_files, refuse_archives, stream_lines

CYCLE = "15 minutes"


def start(writer, once: bool, cycle: str = CYCLE) -> StreamingQuery:
    """Start with one pass over what is there, or a cycle that goes on."""
    trigger = {"availableNow": True} if once else {"processingTime": cycle}
    return writer.trigger(**trigger).start()


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that a running stream keeps in its checkpoint, and a new one does not share."""
    text = "".join(row["value"] for row in spark.read.text(f"{checkpoint}/metadata").collect())
    return json.loads(text)["id"].replace("-", "")


def stamped_stream(rows: DataFrame) -> DataFrame:
    """Add ingest time and its UTC partition columns."""
    seconds = F.unix_seconds("ingest_ts")
    return rows.withColumn("ingest_ts", F.current_timestamp()).select(
        "*",
        F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int")).alias("ingest_date"),
        F.floor(seconds % 86400 / 3600).cast("int").alias("ingest_hour"),
    )


def deduplicated(rows: DataFrame, within: str = "1 hour", salts: int = 8) -> DataFrame:
    """Drop repeated event ids that arrive within ``within`` of the first copy.

    The watermark follows the ingest time, so it bounds the state without ever calling a
    row late. Copies are first dropped per id and salt, which spreads a much repeated id
    over ``salts`` tasks; the second pass then sees at most that many copies of it.
    Rows without an id are all kept.
    """
    keys = ["GlobalEventID", "_unnamed"]
    marked = rows.withWatermark("ingest_ts", within).withColumn(
        "_unnamed", F.when(F.col("GlobalEventID").isNull(), F.uuid())
    )
    if salts > 1:
        marked = (
            marked.withColumn("_salt", F.spark_partition_id() % salts)
            .dropDuplicatesWithinWatermark([*keys, "_salt"])
            .drop("_salt")
        )
    return marked.dropDuplicatesWithinWatermark(keys).drop("_unnamed")


def ingest_stream(
    spark: SparkSession,
    raw_dir: str,
    out_dir: str,
    checkpoint_dir: str,
    table: str = "events",
    *,
    within: str = "1 hour",
    salts: int = 8,
    retention_hours: int | None = None,
    max_files: int | None = None,
    pattern: str | None = None,
    once: bool = False,
) -> StreamingQuery:
    """Parse new raw files into a landed table; events are de-duplicated on the way.

    Batches land as the batch cycle's files do, each once: a landing is named after the
    stream's own id, which a new checkpoint changes, and the batch's number. So batch and
    stream may write the same table at the same time, and ``expire`` serves both;
    ``retention_hours`` expires the table after each batch. ``within`` bounds how long a
    repeated event id is remembered.
    """
    place = f"{checkpoint_dir}/ingest_{table}"

    def land(batch: DataFrame, number: int) -> None:
        landing = f"s{stream_id(spark, place)}-{number}"
        if is_landed(spark, table, out_dir, landing):
            # What the de-duplication remembers is kept only of a batch that was run.
            batch.write.format("noop").mode("overwrite").save()
        else:
            now = datetime.now(timezone.utc)
            land_once(batch, spark.createDataFrame([(landing, now)], MARKS), table, out_dir, landing)
            if retention_hours:
                expire(spark, out_dir, table, now, retention_hours)

    if pattern is None:
        refuse_archives(raw_files(spark, raw_dir, table))
    rows = stamped_stream(parse_lines(stream_lines(spark, raw_dir, table, max_files, pattern), table))
    if table == "events":
        rows = deduplicated(rows, within, salts)
    writer = (
        rows.writeStream.foreachBatch(land)
        .option("checkpointLocation", place)
        .queryName(f"ingest_{table}")
    )
    return start(writer, once)
