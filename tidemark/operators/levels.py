"""Arithmetic on file metadata: overlap, containment, level sizes, what to compact, where to cut.

A file is a row (number, level, smallest, largest, entries, ...). These functions work on
DataFrames of such rows, so that a catalog table of any size can be asked; Table applies the
same rules to its manifest, which it holds on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import ENTRY_OVERHEAD


def file_statistics(log: DataFrame, *by: str) -> DataFrame:
    """A row for each file of a log: entries, key range, seq range. by: what tells files apart, file_no unless given."""
    return log.groupBy(*(by or ["file_no"])).agg(
        F.count("*").alias("entries"), F.min("key").alias("smallest"), F.max("key").alias("largest"),
        F.min("seq").alias("min_seq"), F.max("seq").alias("max_seq"),
    )


def files_containing(files: DataFrame, key) -> DataFrame:
    """Files whose range holds a key."""
    return files.where((F.col("smallest") <= F.lit(key)) & (F.lit(key) <= F.col("largest")))


def files_overlapping(files: DataFrame, start, end) -> DataFrame:
    """Files whose range meets [start, end]."""
    return files.where((F.col("largest") >= F.lit(start)) & (F.col("smallest") <= F.lit(end)))


def level_overlap(upper: DataFrame, lower: DataFrame) -> DataFrame:
    """Pairs of files of two levels whose key ranges meet."""
    a = upper.select(F.col("file_no").alias("upper_file"), F.col("smallest").alias("a_lo"), F.col("largest").alias("a_hi"))
    b = lower.select(F.col("file_no").alias("lower_file"), F.col("smallest").alias("b_lo"), F.col("largest").alias("b_hi"))
    return a.join(b, (F.col("a_hi") >= F.col("b_lo")) & (F.col("a_lo") <= F.col("b_hi"))).select("upper_file", "lower_file")


def level_sizes(files: DataFrame) -> DataFrame:
    """Files, entries and estimated bytes of each level."""
    return files.groupBy("level").agg(F.count("*").alias("n_files"), F.sum("entries").cast("long").alias("entries"), (F.sum("entries") * ENTRY_OVERHEAD).cast("long").alias("bytes"))


def level_violations(files: DataFrame) -> DataFrame:
    """Pairs of files of one level above 0 whose ranges meet: none in a sound table."""
    a = files.where("level > 0").select("level", F.col("file_no").alias("first_file"), F.col("smallest").alias("a_lo"), F.col("largest").alias("a_hi"))
    b = files.where("level > 0").select("level", F.col("file_no").alias("second_file"), F.col("smallest").alias("b_lo"), F.col("largest").alias("b_hi"))
    meets = (F.col("a_hi") >= F.col("b_lo")) & (F.col("a_lo") <= F.col("b_hi")) & (F.col("first_file") < F.col("second_file"))
    return a.join(b, "level").where(meets).select("level", "first_file", "second_file")


def cut_points(sizes: list[tuple[bytes, int]], target: int) -> list[bytes]:
    """First keys of the output files but the first: a file ends with the key that fills it.

    sizes are keys in order with the bytes of all their versions, so that a key is never split.
    """
    cuts, filled = [], 0
    for i, (key, size) in enumerate(sizes):
        if filled >= target:
            cuts.append(key)
            filled = 0
        filled += size
    return cuts


def greedy_files(log: DataFrame, target: int, group: str) -> DataFrame:
    """Each key of a log with the number, from 0, of the output file a greedy cut gives it, by group.

    A file is closed once its versions reach the target, and the count starts anew, so this is a
    fold over the group's keys in order; a group is one key range of a compaction, whose size
    the planner bounds. Keys are never split.
    """
    version = F.lit(17) + F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))
    keys = log.groupBy(group, "key").agg(F.sum(version).cast("long").alias("bytes"))
    listed = keys.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("key", "bytes"))).alias("keys"))
    start = F.struct(F.lit(0).cast("long").alias("filled"), F.lit(0).alias("file"), F.array().cast("array<int>").alias("out"))

    def step(acc, x):
        full = acc["filled"] >= target
        file = acc["file"] + F.when(full, 1).otherwise(0)
        return F.struct((F.when(full, F.lit(0)).otherwise(acc["filled"]) + x["bytes"]).cast("long").alias("filled"), file.alias("file"), F.concat(acc["out"], F.array(file)).alias("out"))

    files = F.aggregate("keys", start, step, lambda acc: acc["out"])
    return listed.select(group, F.explode(F.arrays_zip(F.col("keys.key").alias("key"), F.col("keys.bytes").alias("bytes"), files.alias("file"))).alias("z")).select(group, "z.key", "z.bytes", "z.file")
