"""Approximate nearest neighbours: probed lists with an adaptive dimension scan.

Centroids deal all vectors into lists. They are fitted in two steps: coarse ones on at most
`sample` vectors on the driver, and then, for each coarse list of over `target` vectors, finer ones on
FIT vectors for each, drawn by hash, by the executors. So lists grow in number with the table (up to
coarse x FINE, target being about the root of the table's size) and a query's share of it shrinks.
A query probes its nearest lists; how many is calibrated on the sample to reach `recall`. Within a
list, vectors turned by a random rotation are scanned in blocks of columns: after each block a
hypothesis test on the partial distance abandons candidates that are, at the given confidence, farther
than the query's bound (its k-th distance among the sample's vectors in the lists it probes,
then within the list). Survivors are measured exactly on the vectors as given. A query goes to each
list that it probes once; a list of over CHUNK vectors, such as copies of one, is dealt out in
chunks, and a task holds one chunk and a batch of queries.

The driver holds the sample and the centroids; queries are never collected. Vectors that are
null, of another width than most, zero or not finite, and rows without a vec_id, take no part. Rows of
one vec_id are one vector, the smallest as bytes, as query and as candidate. Equal vectors tie and go by vec_id.
Fewer candidates than k give fewer rows; an empty table gives none; other columns are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, forget, shuffle_partitions
from .vectors import common_width, stack, valid_vectors

COLUMNS = 16
CHUNK = 1 << 16
#: Finer centroids of a coarse list at most, and vectors that each is fitted on.
FINE, FIT = 128, 64
#: Units in the last place, for each column, that a squared distance may be off, as a share of the squared norms.
ROUNDING = 16


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * x @ y.T, 0)


def exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of paired rows."""
    return np.sqrt(((x - y) ** 2).sum(axis=1))


def centroids_of(x: np.ndarray, n: int, steps: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), n, replace=False)]
    for _ in range(steps):
        own = squared(x, c).argmin(1)
        sums, sizes = np.zeros_like(c), np.bincount(own, minlength=n)
        np.add.at(sums, own, x)
        c = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], x[rng.choice(len(x), n)])
    return c


class Index:
    """What a search needs to know on every executor: sample, centroids, probes, rotation."""

    def __init__(self, ids, x, total: int, k: int, recall: float, seed: int):
        self.ids, self.x, self.k, self.recall, self.seed = ids, x, k, recall, seed
        self.rotation = np.linalg.qr(np.random.default_rng(seed).normal(size=(x.shape[1], x.shape[1])))[0]
        self.use(centroids_of(x, int(max(1, min(512, len(x) // 16, 2 * np.sqrt(total)))), 8, seed))

    def use(self, centroids: np.ndarray) -> None:
        """Take these centroids, and calibrate the number of lists to probe."""
        self.centroids, x, k = centroids, self.x, self.k
        own = self.own = self.lists(x)
        tried = np.random.default_rng(self.seed + 1).choice(len(x), min(len(x), 256), replace=False)
        d = squared(x[tried], x)
        d[np.arange(len(tried)), tried] = np.inf
        near = np.argsort(d, axis=1)[:, : min(k, len(x) - 1)]
        order = np.argsort(squared(x[tried], centroids), axis=1)
        place = np.argsort(order, axis=1)
        needed = np.sort(np.take_along_axis(place, own[near], axis=1).ravel()) if near.size else np.zeros(1, int)
        self.probes = int(needed[min(len(needed) - 1, int(np.ceil(self.recall * len(needed))) - 1)]) + 1

    def lists(self, x: np.ndarray) -> np.ndarray:
        step = max(1, (1 << 22) // len(self.centroids))
        return np.concatenate([squared(x[at : at + step], self.centroids).argmin(1) for at in range(0, len(x), step)]) if len(x) else np.zeros(0, np.int64)

    def probed(self, x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Which lists each query probes: the calibrated number, more where these hold too few vectors."""
        order = np.argsort(squared(x, self.centroids), axis=1)
        enough = (sizes[order].cumsum(axis=1) <= self.k).sum(axis=1) + 1
        out = np.zeros(order.shape, bool)
        np.put_along_axis(out, order, np.arange(order.shape[1]) < np.maximum(enough, self.probes)[:, None], axis=1)
        return out

    def bounds(self, ids: np.ndarray, x: np.ndarray, probed: np.ndarray) -> np.ndarray:
        """Each query's k-th distance among the sample's vectors in its lists: no result of these lies farther."""
        out = np.full(len(x), np.inf)
        for at in range(0, len(x), 256):
            part = slice(at, at + 256)
            d = squared(x[part], self.x)
            d[(ids[part, None] == self.ids) | ~probed[part][:, self.own]] = np.inf
            if d.shape[1] >= self.k:
                near = np.argpartition(d, self.k - 1, axis=1)[:, : self.k]
                for i, cols in enumerate(near):
                    if np.isfinite(d[i, cols]).all():
                        out[at + i] = exact(self.x[cols], x[at + i][None]).max()
        return out


def scan(query_ids, q, bounds, ids, x, rotation, k: int, confidence: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (query, candidate, distance) of each query's k nearest of a list, by the adaptive scan."""
    width = x.shape[1]
    rx, rq = x @ rotation, q @ rotation
    # What rounding can add to a squared distance, of the expanded form or of turned vectors.
    tiny = ROUNDING * width * np.finfo(float).eps
    of_q, of_x = tiny * (q * q).sum(1), tiny * (x * x).sum(1)
    out = []
    for at in range(0, len(q), 64):
        part = slice(at, at + 64)
        slack = of_q[part, None] + of_x
        r2 = bounds[part] ** 2 * (1 + 1e-9)
        if len(x) > 4 * k:  # a few whole distances bound the rest
            few = squared(q[part], x[: 4 * k]) + slack[:, : 4 * k]
            few[query_ids[part, None] == ids[: 4 * k]] = np.inf
            r2 = np.minimum(r2, np.partition(few, k - 1, axis=1)[:, k - 1] * (1 + 1e-9))
        done = min(COLUMNS, width)
        d2 = squared(rq[part, :done], rx[:, :done])
        keep = ((d2 - slack) * (width / done) <= r2[:, None] * (1 + confidence / np.sqrt(done)) ** 2) & (query_ids[part, None] != ids)
        i, j = np.nonzero(keep)
        d2 = d2[i, j]
        while done < width and len(i):
            more = min(done + COLUMNS, width)
            d2 = d2 + ((rq[at + i, done:more] - rx[j, done:more]) ** 2).sum(axis=1)
            done = more
            limit = r2[i] * ((1 + confidence / np.sqrt(done)) ** 2 * done / width if done < width else 1 + 1e-9) + slack[i, j]
            alive = d2 <= limit
            i, j, d2 = i[alive], j[alive], d2[alive]
        if len(i):
            d = exact(q[at + i], x[j])
            order = np.lexsort((ids[j], d, i))
            i, j, d = i[order], j[order], d[order]
            first = np.searchsorted(i, i)
            top = np.arange(len(i)) - first < k
            out.append((query_ids[at + i[top]], ids[j[top]], d[top]))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def nearest(table: DataFrame, every: int = 100, k: int = 10, sample: int = 8_192, recall: float = 0.97, confidence: float = 2.1, seed: int = 11, target: int = 0) -> DataFrame:
    """query_id, rank, vec_id and score (Euclidean distance) of the k nearest found of each query.

    Queries are the rows whose vec_id is divisible by `every`; target is the size above which a coarse list
    is split, 0 for about eight times the root of the table's size.
    """
    spark = table.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    width = common_width(table)
    if not width:
        return spark.createDataFrame([], schema)
    rows, path = cut(valid_vectors(table, width), "nearest-vectors")
    total, distinct = rows.agg(F.count("*"), F.count_distinct("vec_id")).first()
    if total > distinct:
        rows, new = cut(rows.groupBy("vec_id").agg(F.min("v").alias("v")), "nearest-vectors")
        forget(spark, path)
        path, total = new, distinct
    share = min(1.0, 1.5 * sample / max(1, total))
    got = _drawn(rows, F.lit(share)).orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toPandas()  # at most `sample` rows, of about 1.5 as many
    if len(got) < 2:
        return spark.createDataFrame([], schema)
    index = Index(got["vec_id"].to_numpy(), np.frombuffer(b"".join(got["v"]), np.float64).reshape(-1, width), total, k, recall, seed)
    _refine(rows, index, total, width, target or 8 * int(np.sqrt(total)) + 64)
    shared = spark.sparkContext.broadcast(index)
    dealt, p_dealt = cut(rows.mapInArrow(_dealer(shared, width), "list long, vec_id long, v binary"), "nearest-lists")
    sizes = {r["list"]: r["count"] for r in dealt.groupBy("list").count().collect()}  # one row a list
    counts = np.array([sizes.get(i, 0) for i in range(len(index.centroids))])
    split = {i: -(-n // CHUNK) for i, n in sizes.items() if n > CHUNK}  # at most total / CHUNK
    of = F.coalesce(F.element_at(F.create_map(*[F.lit(v).cast("long") for kv in split.items() for v in kv]), F.col("list")), F.lit(1)) if split else F.lit(1).cast("long")

    def ask(batches):
        for batch in batches:
            if batch.num_rows:
                x, ids, own = stack(batch.column(1), width), batch.column(0).to_numpy(), shared.value
                for at in range(0, len(x), 256):
                    part = slice(at, at + 256)
                    probed = own.probed(x[part], counts) & (counts > 0)
                    row, lists = np.nonzero(probed)
                    take = pa.array(at + row)
                    yield pa.RecordBatch.from_arrays([pa.array(lists), batch.column(0).take(take), batch.column(1).take(take), pa.array(own.bounds(ids[part], x[part], probed)[row])], ["list", "vec_id", "v", "bound"])

    held = dealt.select("list", F.pmod(F.xxhash64("vec_id"), of).cast("long").alias("chunk"), F.lit(0).alias("kind"), "vec_id", "v", F.lit(0.0).alias("bound"))
    asked = rows.where(F.col("vec_id") % every == 0).mapInArrow(ask, "list long, vec_id long, v binary, bound double")
    asked = asked.select("list", F.explode(F.sequence(F.lit(0).cast("long"), (of - 1).cast("long"))).alias("chunk"), F.lit(1).alias("kind"), "vec_id", "v", "bound")

    def search(batches):
        of, ids, x = None, [], []
        for batch in batches:
            where, kind = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], 1), batch.column(2).to_numpy()
            if not len(kind):
                continue
            cuts = [0, *(np.flatnonzero((where[1:] != where[:-1]).any(1) | (kind[1:] != kind[:-1])) + 1).tolist()]
            for a, b in zip(cuts, [*cuts[1:], len(kind)]):
                own, part = tuple(where[a]), batch.slice(a, b - a)
                if own != of:
                    of, ids, x = own, [], []
                if kind[a] == 0:
                    ids.append(part.column(3).to_numpy())
                    x.append(stack(part.column(4), width))
                elif ids:
                    if len(ids) > 1:
                        ids, x = [np.concatenate(ids)], [np.concatenate(x)]
                    q, c, d = scan(part.column(3).to_numpy(), stack(part.column(4), width), part.column(5).to_numpy(), ids[0], x[0], shared.value.rotation, k, confidence)
                    yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(c), pa.array(d)], ["query_id", "vec_id", "score"])

    met = held.unionByName(asked).repartition(shuffle_partitions(spark), "list", "chunk").sortWithinPartitions("list", "chunk", "kind")
    found, _ = cut(met.mapInArrow(search, "query_id long, vec_id long, score double"), "nearest-found")
    forget(spark, path, p_dealt)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _drawn(rows: DataFrame, share) -> DataFrame:
    """About a share of the rows, told by the hash of vec_id."""
    return rows.where(F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(1 << 30)) < share * float(1 << 30))


def _dealer(shared, width: int):
    def deal(batches):
        for batch in batches:
            if batch.num_rows:
                x = stack(batch.column(1), width)
                yield pa.RecordBatch.from_arrays([pa.array(shared.value.lists(x)), batch.column(0), batch.column(1)], ["list", "vec_id", "v"])

    return deal


def _refine(rows: DataFrame, index: Index, total: int, width: int, target: int) -> None:
    """Replace centroids whose lists have more than `target` vectors by finer ones."""
    spark = rows.sparkSession
    if total <= target * len(index.centroids):
        return
    shared = spark.sparkContext.broadcast(index)
    dealt = rows.mapInArrow(_dealer(shared, width), "list long, vec_id long, v binary")
    sizes = {r["list"]: r["count"] for r in dealt.groupBy("list").count().collect()}  # at most 512 rows
    parts = {i: min(FINE, -(-n // target)) for i, n in sizes.items() if n > target}
    if not parts:
        return
    share = [min(1.0, FIT * parts.get(i, 0) / sizes.get(i, 1)) for i in range(len(index.centroids))]
    drawn = _drawn(dealt, F.element_at(F.array(*map(F.lit, share)), (F.col("list") + 1).cast("int")))
    seed = index.seed

    def fit(key, group):
        x, n = stack(group.column("v"), width), parts[key[0].as_py()]
        x = x[np.argsort(group.column("vec_id").to_numpy())]
        c = centroids_of(x, min(n, len(x)), 6, seed)
        return pa.table({"list": pa.array([key[0].as_py()] * len(c), pa.int64()), "c": pa.array([r.tobytes() for r in c], pa.binary())})

    fine = drawn.groupBy("list").applyInArrow(fit, "list long, c binary").collect()  # the centroids
    kept = [i for i in range(len(index.centroids)) if i not in {r["list"] for r in fine}]
    index.use(np.concatenate([index.centroids[kept], *(np.frombuffer(bytes(r["c"]), np.float64)[None] for r in sorted(fine, key=lambda r: (r["list"], bytes(r["c"]))))]))
