"""Result sets and the run log on storage."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType, TimestampType

from wirepulse.operators.views import ordering
from wirepulse.plans.registry import ANALYSES
from wirepulse.session import file_system
from wirepulse.sources.landed import utc

RUN_LOG = "pipeline_runs"

#: Empty copies of the result sets, which hold their schemas.
SCHEMAS = "_schemas"

#: What each named run has written so far.
MANIFEST = "_manifest"

RUN_LOG_SCHEMA = StructType([
    StructField("run_id", StringType()),
    StructField("started_at", TimestampType()),
    StructField("ended_at", TimestampType()),
    StructField("status", StringType()),
    StructField("failed", StringType()),
])

_FILE_FORMATS = ("parquet", "orc", "json", "csv")


def write_result(
    df: DataFrame,
    name: str,
    path: str,
    mode: str = "overwrite",
    fmt: str = "parquet",
    sort: Sequence[str] = (),
    options: dict[str, str] | None = None,
    by: str | None = None,
) -> None:
    """Write one result set below ``path``.

    ``by`` partitions files by that column, the layout in which single days are replaced.

    For a format that is no file format (a document-store connector, say) ``path`` is not
    used: the connector gets ``name`` as its ``collection`` option, and ``options``.
    """
    out = df.orderBy(*ordering(sort)) if sort else df
    writer = out.write.mode(mode).format(fmt).options(**(options or {}))
    if fmt in _FILE_FORMATS:
        _note_schema(df, name, path)
        (writer.partitionBy(by) if by else writer).save(f"{path}/{name}")
    else:
        writer.option("collection", name).save()


def _note_schema(df: DataFrame, name: str, path: str) -> None:
    """Keep the columns' types and order, which partition folders do not tell."""
    df.limit(0).coalesce(1).write.mode("overwrite").parquet(f"{path}/{SCHEMAS}/{name}")


def write_days(df: DataFrame, name: str, path: str, days: DataFrame | None = None, by: str = "date") -> None:
    """Replace only the days that ``df`` holds, in a result set partitioned by ``by``.

    Of the recomputed ``days`` (column ``_day``) those without rows are removed. ``df`` is
    read twice then, so hand over a written table.
    """
    spark = df.sparkSession
    _note_schema(df, name, path)
    (
        df.hint("rebalance", by).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(by)
        .parquet(f"{path}/{name}")
    )
    if days is None:
        return
    held = df.select(F.col(by).cast("string").alias("_held")).distinct()
    gone = days.select(F.col("_day").cast("string").alias("_day")).join(held, F.col("_day").eqNullSafe(F.col("_held")), "left_anti")
    names = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    for row in gone.toLocalIterator():
        folder = names.DEFAULT_PARTITION_NAME() if row["_day"] is None else names.escapePathName(row["_day"])
        files, target = file_system(spark, f"{path}/{name}/{by}={folder}")
        files.delete(target, True)


def read_result(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A result set with the columns it was written with, from either layout."""
    schema = spark.read.parquet(f"{path}/{SCHEMAS}/{name}").schema
    return spark.read.schema(schema).parquet(f"{path}/{name}").select(*schema.names)


def read_results(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """All nineteen result sets of a full batch run."""
    return {name: read_result(spark, path, name) for name in ANALYSES}


def note_done(spark: SparkSession, path: str, run_id: str, name: str) -> None:
    """Note that a run has written a result set, with the time."""
    done = spark.range(1).select(F.lit(name).alias("result"), F.current_timestamp().alias("at"))
    done.coalesce(1).write.mode("overwrite").parquet(f"{path}/{MANIFEST}/{run_id}/{name}")


def done_by(spark: SparkSession, path: str, run_id: str) -> set[str]:
    """The result sets that a run has written."""
    files, pattern = file_system(spark, f"{path}/{MANIFEST}/{run_id}/*/_SUCCESS")
    return {status.getPath().getParent().getName() for status in files.globStatus(pattern) or []}


def record_run(
    spark: SparkSession,
    path: str,
    run_id: str,
    started_at: datetime,
    ended_at: datetime,
    failed: Sequence[str] = (),
) -> None:
    """Append one run to the run log, failed ones included."""
    row = (run_id, utc(started_at), utc(ended_at), "failed" if failed else "success", ",".join(failed) or None)
    spark.createDataFrame([row], RUN_LOG_SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/{RUN_LOG}")


def run_log(spark: SparkSession, path: str) -> DataFrame:
    """Runs, newest first."""
    return spark.read.schema(RUN_LOG_SCHEMA).parquet(f"{path}/{RUN_LOG}").orderBy(F.desc("started_at"))
