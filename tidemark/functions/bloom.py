"""Bloom filters over keys: built by partitions, joined by OR, bound by their number of bits.

Files carry Parquet's own filters; this one is for keys of any DataFrame, such as telling which
of many keys a log can hold before it is read. Positions are h1 + i * h2 modulo the bits, of a
64-bit FNV-1a hash and a second one of the same bytes from another start.
"""

from __future__ import annotations

import math
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of FNV-1a.
_BASIS, _PRIME = 0xCBF29CE484222325, 0x100000001B3
_SECOND = _BASIS ^ 0x9E3779B97F4A7C15


def fnv1a(keys: list[bytes], basis: int = _BASIS) -> np.ndarray:
    """64-bit FNV-1a of each key, a byte place at a time over all keys."""
    out = np.full(len(keys), basis, np.uint64)
    if not keys:
        return out
    sizes = np.array([len(k) for k in keys])
    order = np.argsort(-sizes, kind="stable")
    ends, flat = np.cumsum(sizes), np.frombuffer(b"".join(keys), np.uint8)
    starts = ends - sizes
    alive = order
    for place in range(int(sizes.max())):
        alive = alive[: np.searchsorted(-sizes[alive], -place, "left")]
        out[alive] = (out[alive] ^ flat[starts[alive] + place].astype(np.uint64)) * np.uint64(_PRIME)
    return out


class Bloom:
    """A filter of so many bits and probes; without false negatives."""

    def __init__(self, bits: int, probes: int, words: np.ndarray | None = None):
        self.bits, self.probes = max(64, -(-bits // 64) * 64), probes
        self.words = np.zeros(self.bits // 64, np.uint64) if words is None else words

    @classmethod
    def sized(cls, keys: int, bits_per_key: int = 10) -> Bloom:
        return cls(max(1, keys) * bits_per_key, min(30, max(1, round(bits_per_key * math.log(2)))))

    def _places(self, keys: list[bytes]) -> np.ndarray:
        h1, h2 = fnv1a(keys), fnv1a(keys, _SECOND) | np.uint64(1)
        return (h1[:, None] + np.arange(self.probes, dtype=np.uint64) * h2[:, None]) % np.uint64(self.bits)

    def add(self, keys: list[bytes]) -> None:
        at = self._places(keys).ravel()
        np.bitwise_or.at(self.words, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))

    def might_contain(self, keys: list[bytes]) -> np.ndarray:
        at = self._places(keys)
        return ((self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).all(axis=1)

    def to_bytes(self) -> bytes:
        return struct.pack("<IQ", self.probes, self.bits) + self.words.astype("<u8").tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> Bloom:
        probes, bits = struct.unpack_from("<IQ", raw)
        if len(raw) != 12 + bits // 8 or bits % 64 or not 1 <= probes <= 30:
            raise ValueError("not a bloom filter")
        return cls(bits, probes, np.frombuffer(raw, "<u8", offset=12).astype(np.uint64))


def build(df: DataFrame, key: str, keys: int, bits_per_key: int = 10) -> Bloom:
    """The filter of a column, sized for `keys` distinct ones; the driver joins one filter for each of at most 16 tasks."""

    def part(batches):
        own = Bloom.sized(keys, bits_per_key)
        for batch in batches:
            own.add(batch.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([own.to_bytes()], pa.binary())], ["filter"])

    out = Bloom.sized(keys, bits_per_key)
    rows = df.select(F.col(key).cast("binary").alias("k")).where("k is not null").distinct()
    for r in rows.coalesce(16).mapInArrow(part, "filter binary").toLocalIterator():
        out.words |= Bloom.from_bytes(bytes(r[0])).words
    return out


def keep_possible(df: DataFrame, key: str, bloom: Bloom) -> DataFrame:
    """Rows whose key the filter may hold."""
    raw = bloom.to_bytes()

    def run(batches):
        own = Bloom.from_bytes(raw)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(key))
            keys = [k.encode() if isinstance(k, str) else k for k in column.to_pylist()]
            hit = own.might_contain([k or b"" for k in keys]) if keys else np.zeros(0, bool)
            yield batch.filter(pa.array(hit & np.array([k is not None for k in keys], bool)))

    return df.mapInArrow(run, df.schema)
