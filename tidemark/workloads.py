"""Key-value workloads in bulk: writes, reads that hit and miss, range scans, durable writers.

One operation a job would measure the scheduler; these do the same work as Spark jobs over
many operations, and report operations a second. Durable single writes go through group commit.
"""

from __future__ import annotations

import random
import threading
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schema import Options
from .table import Table


def pairs(spark: SparkSession, n: int, value_bytes: int, shuffled: bool) -> DataFrame:
    """n keys of 15 bytes with one value, in key order or not."""
    value = bytes(random.Random(12345).randbytes(value_bytes))
    rows = spark.range(n).select(F.format_string("key%012d", "id").cast("binary").alias("key"), F.lit(bytearray(value)).alias("value"))
    return rows.orderBy(F.xxhash64("key")) if shuffled else rows


def _keys(spark: SparkSession, n: int, low: int, high: int) -> DataFrame:
    return spark.range(n).select(F.format_string("key%012d", (F.lit(low) + F.pmod(F.xxhash64("id"), F.lit(high - low)))).cast("binary").alias("key"))


def run(spark: SparkSession, root: str, n: int = 1_000_000, value_bytes: int = 100, scans: int = 2_000, scan_keys: int = 100, writers: tuple[int, ...] = (1, 4, 8, 16), durable: int = 10_000) -> dict[str, float]:
    """Operations a second of each workload, on new tables below root."""
    options, out = Options(target_file_size=16 << 20, l1_max_bytes=1 << 40, compaction_trigger=1 << 30), {}

    def timed(name: str, count: int, f) -> None:
        began = time.perf_counter()
        f()
        out[name] = round(count / (time.perf_counter() - began), 1)

    tables = {}
    for name, shuffled in (("seq_write", False), ("rand_write", True)):
        tables[name] = Table.open(spark, f"{root}/{name}-{uuid.uuid4().hex}", options)
        timed(name, n, lambda t=tables[name], s=shuffled: t.write_all(pairs(spark, n, value_bytes, s)))
    t = tables["seq_write"]
    noop = lambda df: df.write.format("noop").mode("overwrite").save()
    timed("rand_read_hit", n, lambda: noop(t.multi_get(_keys(spark, n, 0, n))))
    timed("rand_read_miss", n, lambda: noop(t.multi_get(_keys(spark, n, 10 * n, 11 * n))))
    rng = random.Random(12345)
    starts = [rng.randrange(max(1, n - scan_keys)) for _ in range(scans)]
    ranges = spark.createDataFrame([(i, bytearray(b"key%012d" % s), bytearray(b"key%012d" % (s + scan_keys - 1))) for i, s in enumerate(starts)], "id long, start binary, end binary")
    timed("scan", scans, lambda: noop(t.scan_many(ranges)))
    for k in writers:
        w = Table.open(spark, f"{root}/conc-{uuid.uuid4().hex}", Options(auto_compact=False))

        def work(me, w=w, k=k):
            for i in range(durable // k):
                w.put(b"t%d_%06d" % (me, i), b"x" * value_bytes)

        threads = [threading.Thread(target=work, args=(i,)) for i in range(k)]
        timed(f"conc_write_{k}", durable // k * k, lambda threads=threads: [[x.start() for x in threads], [x.join() for x in threads]])
        w.close()
    for t in tables.values():
        t.close()
    return out
