"""Escalation and breaking-news detection on a stream of mentions.

Each detector has two stages joined by a Parquet table. The first counts mentions per
event and time bucket: counts combine before the shuffle, so a story with any share of
the stream costs one row per task and bucket, and its state is one row per bucket. The
second keeps a few numbers per event and reads those counts, never single mentions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from wirepulse.functions.columns import stamp_number, wall_clock
from wirepulse.streaming.ingest import start

COUNTS_SCHEMA = "GlobalEventID long, at timestamp, mentions long"
# The steps see and give epoch milliseconds, which no session time zone can shift.
_ESCALATION_STEP = (
    "GlobalEventID long, mention_ms long, mentions_last_24h long, mentions_this_hour long, escalation_ratio double"
)
_BURST_STEP = "GlobalEventID long, first_ms long, mentions_in_first_hour long"

#: How long an event is remembered after its last count (escalation) or first mention (bursts).
FORGET_SECONDS = 7 * 86400

ESCALATION_SCHEMA = (
    "GlobalEventID long, mention_hour timestamp, mentions_last_24h long, mentions_this_hour long, "
    "escalation_ratio double"
)
BURST_SCHEMA = "GlobalEventID long, first_mention_time timestamp, mentions_in_first_hour long"


def timed_mentions(mentions: DataFrame, delay: str) -> DataFrame:
    """Mentions with a readable time stamp, under a watermark."""
    return (
        mentions.select("GlobalEventID", wall_clock(stamp_number("MentionTimeDate")).cast("timestamp").alias("at"))
        .where(F.col("at").isNotNull())
        .withWatermark("at", delay)
    )


def mention_counts_stream(mentions: DataFrame, delay: str = "1 hour", bucket: str | None = "1 hour") -> DataFrame:
    """Mentions per event and closed bucket; ``bucket=None`` counts per exact time stamp."""
    timed = timed_mentions(mentions, delay)
    if bucket is None:
        return timed.groupBy("GlobalEventID", "at").agg(F.count(F.lit(1)).alias("mentions"))
    return (
        timed.groupBy("GlobalEventID", F.window("at", bucket).alias("bucket"))
        .agg(F.count(F.lit(1)).alias("mentions"))
        .select("GlobalEventID", F.col("bucket.start").alias("at"), "mentions")
    )


def write_stream(df: DataFrame, name: str, out_dir: str, checkpoint_dir: str, once: bool) -> StreamingQuery:
    """Append a stream to a Parquet table, exactly once."""
    writer = (
        df.writeStream.format("parquet").outputMode("append")
        .option("path", f"{out_dir}/{name}")
        .option("checkpointLocation", f"{checkpoint_dir}/{name}")
        .queryName(name)
    )
    return start(writer, once)


def counts_source(spark: SparkSession, out_dir: str, name: str) -> DataFrame:
    return spark.readStream.schema(COUNTS_SCHEMA).parquet(f"{out_dir}/{name}")


def _escalation_step(hours: int, min_ratio: float, forget_ms: int) -> Callable:
    """State: the counts of the event's last observed hours, oldest first, and the last hour."""

    def step(key, chunks, state):
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(chunks)).sort_values("at_ms")
        recent, last = (list(state.get[0]), state.get[1]) if state.exists else ([], 0)
        found = []
        for at, now in zip(rows["at_ms"].tolist(), rows["mentions"].tolist(), strict=True):
            recent = [*recent, now][-hours:]
            total = sum(recent)
            ratio = now / (total + 1)
            if ratio > min_ratio:
                found.append((key[0], at, total, now, ratio))
            last = max(last, at)
        state.update((recent[1 - hours:] if hours > 1 else [], last))
        state.setTimeoutTimestamp(max(last + forget_ms, state.getCurrentWatermarkMs() + 1))
        if found:
            yield pd.DataFrame(found, columns=[
                "GlobalEventID", "mention_ms", "mentions_last_24h", "mentions_this_hour", "escalation_ratio",
            ])

    return step


def _in_epoch(counts: DataFrame, delay: str) -> DataFrame:
    return counts.withWatermark("at", delay).withColumn("at_ms", F.unix_millis("at"))


def escalation_stream(
    counts: DataFrame,
    *,
    min_ratio: float = 0.5,
    hours: int = 24,
    forget_seconds: int = FORGET_SECONDS,
    delay: str = "1 hour",
) -> DataFrame:
    """Escalations from a stream of hourly counts.

    Buckets close in time order, so an event's hours reach its state in order. Looks back
    over observed hours, as the batch analysis does by default, but an event that is silent
    for ``forget_seconds`` is forgotten and starts anew; give the retention of the mentions
    here. Mentions without a readable time, which the batch form counts under a null hour,
    are left out.
    """
    found = _in_epoch(counts, delay).groupBy("GlobalEventID").applyInPandasWithState(
        _escalation_step(hours, min_ratio, forget_seconds * 1000),
        _ESCALATION_STEP,
        "recent array<long>, last long",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )
    return found.select(
        "GlobalEventID", F.timestamp_millis("mention_ms").alias("mention_hour"), "mentions_last_24h", "mentions_this_hour",
        "escalation_ratio",
    )


def _burst_step(threshold: int, horizon_ms: int, forget_ms: int) -> Callable:
    """State: first mention and its horizon count; ``open`` turns 0 once it was judged."""

    def step(key, chunks, state):
        import pandas as pd

        def verdict(first, count):
            if count >= threshold:
                yield pd.DataFrame({
                    "GlobalEventID": [key[0]],
                    "first_ms": [first],
                    "mentions_in_first_hour": [count],
                })

        if state.hasTimedOut:
            first, count, is_open = state.get
            if not is_open:
                state.remove()
                return
            state.update((first, count, 0))
            state.setTimeoutTimestamp(max(first + forget_ms, state.getCurrentWatermarkMs() + 1))
            yield from verdict(first, count)
            return

        rows = pd.concat(list(chunks))
        at = rows["at_ms"].to_numpy()
        first, count, is_open = state.get if state.exists else (int(at.min()), 0, 1)
        watermark = state.getCurrentWatermarkMs()
        if is_open:
            count += int(rows["mentions"].to_numpy()[at <= first + horizon_ms].sum())
            if first + horizon_ms < watermark:
                is_open = 0
                yield from verdict(first, count)
        state.update((first, count, is_open))
        wake = first + (horizon_ms + 1 if is_open else forget_ms)
        state.setTimeoutTimestamp(max(wake, watermark + 1))

    return step


def breaking_stream(
    counts: DataFrame,
    *,
    threshold: int = 100,
    horizon_seconds: int = 3600,
    forget_seconds: int = FORGET_SECONDS,
    delay: str = "1 hour",
) -> DataFrame:
    """Bursts from a stream of counts per exact time stamp.

    An event is judged once, when the watermark passes its first mention plus the horizon.
    Its state is kept ``forget_seconds`` after the first mention, so that later mentions
    do not start it anew; give the retention of the mentions here. An event mentioned for
    longer than that may be reported again, which the batch form never does.
    """
    found = _in_epoch(counts, delay).groupBy("GlobalEventID").applyInPandasWithState(
        _burst_step(threshold, horizon_seconds * 1000, forget_seconds * 1000),
        _BURST_STEP,
        "first long, count long, open int",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )
    return found.select("GlobalEventID", F.timestamp_millis("first_ms").alias("first_mention_time"), "mentions_in_first_hour")


def run_escalation(
    spark: SparkSession,
    mentions: DataFrame,
    out_dir: str,
    checkpoint_dir: str,
    *,
    delay: str = "1 hour",
    once: bool = False,
    **settings,
) -> list[StreamingQuery]:
    """Both stages of escalation detection; with ``once`` the first ends before the second."""
    counting = write_stream(
        mention_counts_stream(mentions, delay), "hourly_mentions", out_dir, checkpoint_dir, once
    )
    if once:
        counting.awaitTermination()
    hourly = counts_source(spark, out_dir, "hourly_mentions")
    detecting = write_stream(
        escalation_stream(hourly, delay=delay, **settings), "escalation_events", out_dir, checkpoint_dir, once
    )
    return [counting, detecting]


def run_breaking(
    spark: SparkSession,
    mentions: DataFrame,
    out_dir: str,
    checkpoint_dir: str,
    *,
    delay: str = "1 hour",
    once: bool = False,
    **settings,
) -> list[StreamingQuery]:
    """Both stages of breaking-news detection; with ``once`` the first ends before the second."""
    named = mentions.where(F.col("GlobalEventID").isNotNull())
    counting = write_stream(
        mention_counts_stream(named, delay, bucket=None), "mention_ticks", out_dir, checkpoint_dir, once
    )
    if once:
        counting.awaitTermination()
    ticks = counts_source(spark, out_dir, "mention_ticks")
    detecting = write_stream(
        breaking_stream(ticks, delay=delay, **settings), "breaking_bursts", out_dir, checkpoint_dir, once
    )
    return [counting, detecting]
