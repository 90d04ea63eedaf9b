"""Garbage collection: which versions a compaction keeps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import LATEST


def collect_garbage(log: DataFrame, oldest: int | None, bottommost: bool) -> DataFrame:
    """Versions that some read at or after the oldest live snapshot can still need.

    Kept are all versions newer than it, and each key's newest version up to it (its anchor).
    At the bottommost level nothing older can lie below, so an anchor that is a tombstone goes
    too. None means no live snapshot: one version of a key survives at most. Equal (key, seq)
    rows, which a crash between commit and truncation can leave, become one.
    """
    bound = LATEST if oldest is None else oldest
    old = F.col("seq") <= F.lit(bound)
    # One window serves both parts: newer versions are ranked among themselves.
    rank = F.row_number().over(Window.partitionBy("key", "_old").orderBy(F.desc("seq")))
    ranked = log.dropDuplicates(["key", "seq"]).withColumn("_old", old).withColumn("_rank", rank)
    anchor = (F.col("_rank") == 1) & ~(F.col("tombstone") & F.lit(bottommost))
    return ranked.where(~F.col("_old") | anchor).drop("_old", "_rank")
