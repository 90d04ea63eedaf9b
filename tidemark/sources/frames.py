"""Checksummed frames of versions: the bytes of a write-ahead segment, and their replay.

A frame is u32 crc32 of the rest, u8 type (1 put, 2 delete), u64 seq, u32 key length, u32 value
length, key, value; integers are little-endian, so a frame has 21 bytes and its key and value.
Replay takes frames up to the first short or wrong one.
"""

from __future__ import annotations

import struct
import zlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import VERSIONS

_HEAD = struct.Struct("<IBQII")
HEAD_BYTES = _HEAD.size
PUT, DELETE = 1, 2

Version = tuple[bytes, int, bool, bytes | None]


def frame(key: bytes, seq: int, tombstone: bool, value: bytes | None) -> bytes:
    value = b"" if tombstone else value
    rest = _HEAD.pack(0, DELETE if tombstone else PUT, seq, len(key), len(value))[4:] + key + value
    return struct.pack("<I", zlib.crc32(rest)) + rest


def replay(raw: bytes) -> tuple[list[Version], int]:
    """Versions of the sound prefix, and its length in bytes."""
    out, at = [], 0
    while at + HEAD_BYTES <= len(raw):
        crc, kind, seq, n_key, n_value = _HEAD.unpack_from(raw, at)
        end = at + HEAD_BYTES + n_key + n_value
        if end > len(raw) or zlib.crc32(raw[at + 4 : end]) != crc or kind not in (PUT, DELETE):
            break
        key = raw[at + HEAD_BYTES : at + HEAD_BYTES + n_key]
        out.append((key, seq, kind == DELETE, None if kind == DELETE else raw[end - n_value : end]))
        at = end
    return out, at


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """Versions of all segments at a path, each to its first bad frame. A segment is one batch, so it fits a task."""
    from collections.abc import Iterator

    import pandas as pd

    def decode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for raw in part["content"]:
                yield pd.DataFrame(replay(bytes(raw))[0], columns=["key", "seq", "tombstone", "value"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(decode, VERSIONS)


def frame_offsets(log: DataFrame, partitions: int = 64) -> DataFrame:
    """The place each version's frame has in one log written in seq order: seq, length, offset.

    A running sum without a single task: seqs are cut into ranges by quantiles, frames are summed
    within a range, and the totals of earlier ranges, one row each, are added.
    """
    length = F.lit(HEAD_BYTES) + F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))
    rows = log.select("seq", length.cast("long").alias("length"))
    edges = rows.agg(F.percentile_approx("seq", [i / partitions for i in range(1, partitions)], 10_000).alias("e"))
    cut = rows.crossJoin(F.broadcast(edges)).select("seq", "length", F.coalesce(F.size(F.filter("e", lambda x: x < F.col("seq"))), F.lit(0)).alias("part"))
    totals = cut.groupBy("part").agg(F.sum("length").alias("total"))
    before = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))
    own = Window.partitionBy("part").orderBy("seq")
    within = cut.withColumn("inside", F.sum("length").over(own) - F.col("length"))
    return within.join(F.broadcast(before), "part").select("seq", "length", (F.col("before") + F.col("inside")).cast("long").alias("offset"))


def frame_checksums(log: DataFrame) -> DataFrame:
    """seq and the crc32 of each version's key and value."""
    return log.select("seq", F.crc32(F.concat(F.col("key").cast("binary"), F.coalesce(F.col("value").cast("binary"), F.lit(b"")))).alias("crc"))


def sound_prefix(frames: DataFrame, ok: str = "ok") -> DataFrame:
    """Rows before the first bad one, in seq order: what replay of a log would accept."""
    bad = frames.where(~F.col(ok)).agg(F.min("seq").alias("_bad"))
    return frames.crossJoin(F.broadcast(bad)).where(F.col("_bad").isNull() | (F.col("seq") < F.col("_bad"))).drop("_bad")
