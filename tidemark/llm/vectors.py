"""Vectors that can be compared: parsing, and a fixed width."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parse(column, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows hold `width` finite components, not all 0, and their matrix in double precision."""
    column = column.cast(pa.large_list(pa.float64())) if not pa.types.is_large_list(column.type) else column
    offsets, null = np.asarray(column.offsets), np.asarray(column.is_null())
    ok = np.flatnonzero((np.diff(offsets) == width) & ~null)
    values = column.values.to_numpy(zero_copy_only=False)
    x = values[offsets[:-1][ok][:, None] + np.arange(width)] if len(ok) else np.zeros((0, width))
    good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    keep = np.zeros(len(column), bool)
    keep[ok[good]] = True
    return keep, x[good]


def common_width(table: DataFrame) -> int:
    """The most frequent number of components; vectors of another take no part. 0 for a table without vectors."""
    got = table.where("embedding is not null and vec_id is not null").groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return got["n"] if got else 0


def valid_vectors(table: DataFrame, width: int) -> DataFrame:
    """vec_id and v, the vector as little-endian doubles, of rows that can be compared."""

    def run(batches):
        for batch in batches:
            keep, x = parse(batch.column(1), width)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), pa.array([r.tobytes() for r in x], pa.binary())], ["vec_id", "v"])

    rows = table.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(run, "vec_id long, v binary")


def stack(column, width: int) -> np.ndarray:
    """The matrix of a column of vectors in bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, width)
