"""Reads: which version of a key a snapshot sees.

Every read goes through newest(): visibility (seq <= snapshot) is tested below it, tombstones
are hidden above it, never below, or a deleted key's older value would come back.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge(*sources: DataFrame) -> DataFrame:
    """All versions of all sources, unordered; duplicates of a (key, seq) may remain."""
    return reduce(DataFrame.unionByName, sources)


def ordered(log: DataFrame) -> DataFrame:
    """Versions by key, newest first."""
    return log.orderBy("key", F.desc("seq"))


def key_range(log: DataFrame, start=None, end=None) -> DataFrame:
    """Versions of keys from start to end, both included; None leaves an end open."""
    if start is not None:
        log = log.where(F.col("key") >= F.lit(start))
    if end is not None:
        log = log.where(F.col("key") <= F.lit(end))
    return log


def as_of(log: DataFrame, snapshot: int | None) -> DataFrame:
    return log if snapshot is None else log.where(F.col("seq") <= F.lit(snapshot))


def newest(log: DataFrame, snapshot: int | None = None) -> DataFrame:
    """The newest visible version of each key, tombstones included.

    One aggregate, combined before the shuffle; predicates on the key above it reach the scan.
    """
    rest = [c for c in log.columns if c != "key"]
    best = as_of(log, snapshot).groupBy("key").agg(F.max_by(F.struct(*rest), "seq").alias("v"))
    return best.select("key", *[F.col(f"v.{c}").alias(c) for c in rest])


def visible(log: DataFrame, snapshot: int | None = None) -> DataFrame:
    """The live rows a snapshot sees."""
    return newest(log, snapshot).where(~F.col("tombstone")).drop("tombstone")


def scan(log: DataFrame, start=None, end=None, snapshot: int | None = None) -> DataFrame:
    """Live rows of keys from start to end, both included."""
    return visible(key_range(log, start, end), snapshot)


def get(log: DataFrame, key, snapshot: int | None = None) -> DataFrame:
    """The live row of one key, or none."""
    return visible(log.where(F.col("key") == F.lit(key)), snapshot)


def versions_from(log: DataFrame, start) -> DataFrame:
    """All versions of keys at or after start."""
    return key_range(log, start)


def lookup_status(log: DataFrame, keys: DataFrame, snapshot: int | None = None) -> DataFrame:
    """Each key with 'Found', 'Deleted' or 'NotFound', and its value where found."""
    seen = newest(log.join(keys.select("key").distinct(), "key", "left_semi"), snapshot)
    status = F.when(F.col("seq").isNull(), "NotFound").when(F.col("tombstone"), "Deleted").otherwise("Found")
    return keys.select("key").distinct().join(seen, "key", "left").select("key", status.alias("status"), F.when(~F.col("tombstone"), F.col("value")).alias("value"))


def multi_get(log: DataFrame, keys: DataFrame, snapshot: int | None = None) -> DataFrame:
    """The live rows of the keys asked for. The log is cut down to these keys before it is aggregated."""
    return visible(log.join(keys.select("key").distinct(), "key", "left_semi"), snapshot)


def missing_keys(log: DataFrame, keys: DataFrame, snapshot: int | None = None) -> DataFrame:
    """The keys asked for that have no live row."""
    return keys.select("key").distinct().join(multi_get(log, keys, snapshot).select("key"), "key", "left_anti")


def as_of_many(log: DataFrame, snapshots: list[int]) -> DataFrame:
    """Live rows at each of several snapshots, with the snapshot's column `snap`.

    Each version goes once to the snapshots between it and the key's next version, so the
    work is one window over the log however many snapshots there are.
    """
    following = F.lead("seq").over(Window.partitionBy("key").orderBy("seq"))
    snaps = F.array(*[F.lit(s).cast("long") for s in sorted(set(snapshots))])
    spans = log.dropDuplicates(["key", "seq"]).withColumn("until", following).where(~F.col("tombstone"))
    sees = F.filter(snaps, lambda s: (s >= F.col("seq")) & (F.col("until").isNull() | (s < F.col("until"))))
    return spans.withColumn("snap", F.explode(sees)).drop("until", "tombstone")


def approximate_bytes(log: DataFrame, overhead: int) -> DataFrame:
    """One row: the estimated size of the versions."""
    size = F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0)) + overhead
    return log.agg(F.coalesce(F.sum(size.cast("long")), F.lit(0)).alias("bytes"))


def first_gap(keys: DataFrame, number: str) -> DataFrame:
    """One row: the least non-negative integer missing from a column, and how many larger ones are there.

    A gap-free prefix means nothing acknowledged was lost: then `beyond` is 0. A number ends the
    prefix when its successor is missing, found by a join, so no task sorts the whole column.
    """
    n = keys.select(F.col(number).cast("long").alias("n")).where("n >= 0").distinct()
    ends = n.join(n.select((F.col("n") - 1).alias("n")), "n", "left_anti")
    starts = n.where("n = 0").select("n")
    gap = ends.agg(F.min("n").alias("last")).crossJoin(starts.agg(F.count("*").alias("has"))).select(F.when(F.col("has") > 0, F.col("last") + 1).otherwise(0).cast("long").alias("first_missing"))
    return gap.crossJoin(n.agg(F.count("*").alias("all_n"))).select("first_missing", (F.col("all_n") - F.col("first_missing")).cast("long").alias("beyond"))


def listed_ranges(ranges: DataFrame, bound: int = 100_000) -> list[tuple[int, bytes, bytes]] | None:
    """The ranges that hold anything, by start, or None if there are more than `bound`."""
    got = ranges.select("id", F.col("start").cast("binary"), F.col("end").cast("binary")).where("start <= end").limit(bound + 1).collect()
    return None if len(got) > bound else sorted(((r[0], bytes(r[1]), bytes(r[2])) for r in got), key=lambda r: r[1])


def scan_many(log: DataFrame, ranges: DataFrame, snapshot: int | None = None, bound: int = 100_000, listed: list[tuple[int, bytes, bytes]] | None = None) -> DataFrame:
    """Live rows of many key ranges (id, start, end; both ends included), each with the range's id.

    Versions outside of all ranges are dropped before any are shuffled. Up to `bound` ranges go to
    every task, which cuts each batch of keys by those that meet it; more than that are dealt, with the
    versions, to key intervals, and each interval is swept in key order.
    """
    log = as_of(log, snapshot)
    if listed is None:
        listed = listed_ranges(ranges, bound)
    types = dict(log.dtypes)
    schema = "id long, " + ", ".join(f"{c} {types[c]}" for c in log.columns)
    if listed is not None:
        found = log.mapInArrow(_cutter(listed, log.columns.index("key")), schema)
    else:
        found = _sweep(log, ranges, schema)
    rest = [c for c in log.columns if c != "key"]
    best = found.groupBy("id", "key").agg(F.max_by(F.struct(*rest), "seq").alias("v"))
    return best.where("not v.tombstone").select("id", "key", *[F.col(f"v.{c}").alias(c) for c in rest if c != "tombstone"])


def _cutter(listed: list[tuple[int, bytes, bytes]], at: int):
    """Batches of versions to those of each range, with its id. Ranges are in order of start."""

    def run(batches):
        import numpy as np

        ids, starts, ends = np.array([r[0] for r in listed], np.int64), _objects([r[1] for r in listed]), _objects([r[2] for r in listed])
        for batch in batches:
            if batch.num_rows and len(ids):
                cut = _meet(batch, at, ids, starts, ends)
                if cut is not None:
                    yield cut

    return run


def _objects(items):
    import numpy as np

    out = np.empty(len(items), object)
    out[:] = items
    return out


def _sortable(column, starts, ends):
    """Keys as an array that sorts as bytes do: of one buffer where keys and bounds have one length, else of objects."""
    import numpy as np
    import pyarrow as pa

    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    size = int(offsets[1] - offsets[0])
    if size and (np.diff(offsets) == size).all() and all(len(k) == size for k in (*starts, *ends)):
        return np.frombuffer(column.buffers()[2], f"S{size}", len(column), int(offsets[0]))
    return _objects(column.to_pylist())


def _meet(batch, at: int, ids, starts, ends):
    """The batch's rows of each range with the range's id, or None."""
    import numpy as np
    import pyarrow as pa

    keys = _sortable(batch.column(at), starts, ends)
    if keys.dtype.kind == "S":
        starts, ends = starts.astype(keys.dtype), ends.astype(keys.dtype)
    if not (keys[1:] >= keys[:-1]).all():
        order = np.argsort(keys, kind="stable")
        keys, batch = keys[order], batch.take(pa.array(order))
    some = np.flatnonzero(ends[: np.searchsorted(starts, keys[-1], "right")] >= keys[0])
    a, b = np.searchsorted(keys, starts[some], "left"), np.searchsorted(keys, ends[some], "right")
    n = b - a
    if not n.sum():
        return None
    rows = np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[some], n)), *batch.take(pa.array(rows)).columns], ["id", *batch.schema.names])


def _sweep(log: DataFrame, ranges: DataFrame, schema: str) -> DataFrame:
    """Versions of each range, with its id, by key intervals: a task holds one batch and the ranges open at its keys."""
    spark, at = log.sparkSession, log.columns.index("key")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = ranges.select("id", F.col("start").cast("binary").alias("start"), F.col("end").cast("binary").alias("end")).where("start <= end")
    # Which starts are edges only matters for the balance of intervals: at most 64 a partition.
    drawn = asked.select("start").distinct().orderBy(F.xxhash64("start")).limit(64 * parts).collect()
    edges = sorted(bytes(r[0]) for r in drawn)

    def place(batches):
        import numpy as np
        import pyarrow as pa

        cuts = _objects(edges)
        for batch in batches:
            keys = _objects([k.encode() if isinstance(k, str) else k for k in batch.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(cuts, keys, "right").astype(np.int64)), *batch.columns], ["interval", *batch.schema.names])

    def spread(batches):
        import numpy as np
        import pyarrow as pa

        cuts = _objects(edges)
        for batch in batches:
            a, b = (np.searchsorted(cuts, _objects(batch.column(k).to_pylist()), "right") for k in (1, 2))
            n = b - a + 1
            rows = np.repeat(np.arange(batch.num_rows), n)
            where = np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64)[: len(n)], n) + np.arange(n.sum())
            yield pa.RecordBatch.from_arrays([pa.array(where.astype(np.int64)), *batch.take(pa.array(rows)).columns], ["interval", *batch.schema.names])

    types = dict(log.dtypes)
    own = ", ".join(f"{c} {types[c]}" for c in log.columns)
    rows = log.mapInArrow(place, f"interval long, {own}").select("interval", F.lit(1).alias("kind"), F.col("key").cast("binary").alias("_at"), F.lit(None).cast("long").alias("_id"), F.lit(None).cast("binary").alias("_end"), *[F.col(c) for c in log.columns])
    spans = asked.mapInArrow(spread, "interval long, id long, start binary, end binary")
    spans = spans.select("interval", F.lit(0).alias("kind"), F.col("start").alias("_at"), F.col("id").alias("_id"), F.col("end").alias("_end"), *[F.lit(None).cast(types[c]).alias(c) for c in log.columns])
    met = rows.union(spans).repartition(parts, "interval").sortWithinPartitions("interval", "_at", "kind")

    def sweep(batches):
        import numpy as np
        import pyarrow as pa

        interval, held = None, (np.zeros(0, np.int64), _objects([]), _objects([]))
        for batch in batches:
            where, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for a, b in zip(cuts := [0, *(np.flatnonzero(np.diff(where)) + 1).tolist()], [*cuts[1:], batch.num_rows]):
                if a == b:
                    continue
                if where[a] != interval:
                    interval, held = where[a], (np.zeros(0, np.int64), _objects([]), _objects([]))
                part, opens = batch.slice(a, b - a), np.flatnonzero(kind[a:b] == 0)
                new = part.take(pa.array(opens))
                held = (np.concatenate([held[0], new.column(3).to_numpy(zero_copy_only=False).astype(np.int64)]), np.concatenate([held[1], _objects(new.column(2).to_pylist())]), np.concatenate([held[2], _objects(new.column(4).to_pylist())]))
                rows = part.take(pa.array(np.flatnonzero(kind[a:b] == 1)))
                rows = pa.RecordBatch.from_arrays(rows.columns[5:], rows.schema.names[5:])
                if rows.num_rows and len(held[0]):
                    cut = _meet(rows, at, *held)
                    if cut is not None:
                        yield cut
                    last = part.column(2)[-1].as_py()
                    still = held[2] >= last
                    held = tuple(h[still] for h in held)

    return met.mapInArrow(sweep, schema)
