"""Scratch tables, column selection and connected components, shared by the operators."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters, or bytes, of text that a worker takes apart at once.
SLICE = 1 << 23
_own_root: list[str] = []


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where that is unset and the executors run here."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        if not _own_root:
            _own_root.append(tempfile.mkdtemp(prefix="tidemark-"))
        root = f"file://{_own_root[0]}"
    return f"{root.rstrip('/')}/tidemark"


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write df to the shared folder and read it back: cuts lineage, and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def forget(spark: SparkSession, *paths: str) -> None:
    """Delete scratch tables that no returned DataFrame reads, and the shuffle files of the steps before."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    release(spark)


def release(spark: SparkSession) -> None:
    """Let the executors delete shuffle files that no plan needs: Spark does when the driver's collector has run, which it rarely does by itself."""
    spark._jvm.System.gc()


def fresh_worker() -> None:
    """Give up what operators that ran earlier in this Python worker still hold: caches and freed buffers."""
    for name in ("tokens", "pieces"):
        module = sys.modules.get(f"{__package__}.{name}")
        if module is not None:
            module.loaded.clear()
    trim()


def trim() -> None:
    """Hand freed memory back to the machine, which idle Python workers would keep."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    release = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if release is not None:
        release(0)


def bound_batches(spark: SparkSession) -> None:
    """From now on this session's Arrow batches end at SLICE bytes, unless less is set: by default one takes 64 MB in the JVM, and again in Python."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(key, None)
    if not held or not 0 < spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(held) <= SLICE:
        spark.conf.set(key, str(SLICE))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(texts: list[str]):
    """(first, texts) of runs of about SLICE characters."""
    part, at, size = [], 0, 0
    for i, t in enumerate(texts):
        part.append(t)
        size += len(t)
        if size >= SLICE:
            yield at, part
            part, at, size = [], i + 1, 0
    if part:
        yield at, part


def text_slices(column, size: int | None = None):
    """(first, texts) of runs of about `size` (SLICE) bytes of an Arrow column, a null as the empty text: Python never holds a whole batch's texts."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0)).astype(np.int64)
    if len(sizes):
        starts = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // (size or SLICE), prepend=-1)).tolist()
        for a, b in zip(starts, [*starts[1:], len(sizes)]):
            yield a, [t or "" for t in column.slice(a, b - a).to_pylist()]


def texts_of(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, a null text as the empty one; further columns, of whatever name, are left out."""
    bound_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def components(edges: DataFrame, label: str, rounds: int = 60, bound: int = 1 << 20) -> tuple[DataFrame, str]:
    """Connected components of edges (a, b): (node, component), the component being the smallest node reachable.

    Nodes without an edge to another are left out. Up to `bound` edges are joined by one task, in
    16 MB; beyond, large and small stars alternate. Either way edges live in scratch tables,
    and the driver sees their count alone.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, path = cut(edges, f"{label}-edges")
    seen = _state(edges)
    if seen[0] <= bound:
        found, new = cut(edges.coalesce(1).mapInArrow(_join, "node long, component long"), f"{label}-components")
        forget(edges.sparkSession, path)
        return found, new
    return _stars(edges, path, seen, label, rounds)


def _join(batches):
    """Smallest reachable node of each node, by passing labels along edges and jumping to the label's label."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if parts:
        u, v = (np.concatenate(c) for c in zip(*parts))
        nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        i, j = at[: len(u)], at[len(u) :]
        least = np.arange(len(nodes))
        while True:
            new = least.copy()
            np.minimum.at(new, least[i], least[j])
            np.minimum.at(new, least[j], least[i])
            np.minimum.at(new, i, new[j])
            np.minimum.at(new, j, new[i])
            new = new[new]
            if (new == least).all():
                break
            least = new
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[least])], ["node", "component"])


def _stars(edges: DataFrame, path: str, seen: tuple, label: str, rounds: int) -> tuple[DataFrame, str]:
    """Each round is two aggregates and two joins on the node, until the edges stay the same."""
    spark = edges.sparkSession
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large, mid = cut(large, f"{label}-large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v")))
        small = small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        edges, new = cut(small, f"{label}-small")
        now = _state(edges)
        forget(spark, path, mid)
        path = new
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"{label}: components did not settle in {rounds} rounds")
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return nodes.union(roots), path


def _state(edges: DataFrame) -> tuple:
    got = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return got[0], got[1]
