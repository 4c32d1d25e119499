"""Rank-limited groups that hold under skew."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def keep_top_ranked(counted: DataFrame, within: list[str], measure: str, k: int) -> DataFrame:
    """Rows whose SQL ``rank()`` by descending ``measure`` in their group is at most ``k``.

    As the rank filter stands directly above the window, Spark drops rows of a local rank
    beyond ``k`` in every task before the shuffle (a window group limit). What is shuffled
    is ``k`` rows and their ties per task and group, however many rows a group has.
    """
    order = Window.partitionBy(*within).orderBy(F.desc(measure))
    return counted.withColumn("rank", F.rank().over(order)).where(F.col("rank") <= k).select(*counted.columns, "rank")
