"""Percentiles that are elements: the value at place n * p / 100 of the sorted sample."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def nth_element(df: DataFrame, group: str, value: str, percents: list[int]) -> DataFrame:
    """n and p{percent} of each group: the sorted sample's element at place n * percent div 100, from 0.

    Equal values are counted first, so a group's work is one window over its distinct values
    and a hot group is combined before the shuffle. Null values don't count.
    """
    from pyspark.sql import Window

    counted = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("c"))
    by = Window.partitionBy(group)
    ranked = counted.withColumn("upto", F.sum("c").over(by.orderBy(value))).withColumn("n", F.sum("c").over(by))
    place = lambda p: F.least(F.floor(F.col("n") * p / 100).cast("long"), F.col("n") - 1)
    return ranked.groupBy(group).agg(F.max("n").alias("n"), *[F.min(F.when(F.col("upto") > place(p), F.col(value))).alias(f"p{p}") for p in percents])
