"""Near-duplicate vectors by counting collisions of one-dimensional projections.

Two vectors link when their cosine is at least `least`. Sorted lists hold all vectors, each in order
of a random projection of its own; in a list, further projections, rounded, keep strangers
apart in cells (their number grows with the logarithm of the number of vectors), which is what lets a window
stay small in a long list. A window centred at each vector, within its cell, gives its collisions;
pairs that collide in at least `count` lists are verified exactly. There are as many lists as a pair just
at the threshold collides in MEAN of on average, and the count is the largest that such a pair reaches
with a chance of `recall` (nearer pairs collide more often).

Equal vectors are one, with a weight. Vectors close together are grouped before that, in coarse cells
cut by another projection: a tight group lies within half the threshold's angle of its centre, so all its
members link; the members of a loose group link with its leader, and their links with each other are
counted there, block by block. No link inside a group is listed. In the sorted lists a group's members
in one cell are one interval. Groups that the triangle inequality decides are linked or dropped whole;
others are compared member by member in blocks. So a family that holds much of the table costs rows
in proportion to its size, and its links are still all counted.

Vectors that are null, of another width than most, zero or not finite link with nothing.
Rows with equal vec_id are vectors of their own; a null vec_id is kept and links with nothing. An empty
table gives no rows; other columns, of any name, are left out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ngrams import groups_in, mix
from .shared import components, cut, forget, shuffle_partitions
from .vectors import common_width, parse, stack

CELL = 4.0  # a cell's width, and
WINDOW = 2.0  # a window's half width, in distances at the threshold
BALL, BLOCK, MARGIN = 8, 4096, 1e-6
#: Lists in which a pair at the threshold collides, on average.
MEAN = 12


def cell_chance(distance: float, width: float) -> float:
    """The chance that a projection rounds two vectors so far apart to one cell."""
    u = width / distance
    return math.erf(u / math.sqrt(2)) - math.sqrt(2 / math.pi) / u * (1 - math.exp(-u * u / 2))


def calibrate(total: int, least: float, recall: float, mean: float = MEAN) -> tuple[int, int, int, float]:
    """Projections of a cell, number of lists, the count that a pair at the threshold reaches with a chance of recall, and its distance."""
    near, far = math.sqrt(2 - 2 * least), math.sqrt(2)
    stranger = cell_chance(far, CELL * near)
    window = math.erf(WINDOW / math.sqrt(2))
    cells = max(1, math.ceil(math.log(max(2.0, total)) / -math.log(stranger)))
    p = cell_chance(near, CELL * near) ** cells * window
    lists, count, below = math.ceil(mean / p), 0, 0.0
    while below <= 1 - recall:
        below += math.comb(lists, count) * p**count * (1 - p) ** (lists - count)
        count += 1
    return cells, lists, max(1, count - 1), near


class Lists:
    """The random projections of all lists, from a seed."""

    def __init__(self, width: int, cells: int, lists: int, near: float, seed: int):
        rng = np.random.default_rng(seed)
        self.size = CELL * near
        self.rounding = rng.normal(size=(lists, width, cells))
        self.shift = rng.uniform(0, self.size, (lists, cells))
        self.order = rng.normal(size=(width, lists))
        self.odd = rng.integers(1, 1 << 63, cells, dtype=np.uint64) | np.uint64(1)

    def cells(self, x: np.ndarray, k: int, some: int | None = None) -> np.ndarray:
        """Each vector's cell in a list, by all of its projections or the first few."""
        at = np.floor((x @ self.rounding[k][:, :some] + self.shift[k][:some]) / self.size).astype(np.int64).astype(np.uint64)
        return mix((at * self.odd[:some]).sum(axis=1, dtype=np.uint64) + np.uint64(k)).astype(np.int64)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1)[:, None]


def balls_in(x: np.ndarray, least: float) -> list[tuple[np.ndarray, np.ndarray, bool]]:
    """Groups of at least BALL unit vectors (places, centre, whether tight).

    A tight one lies within half the threshold's angle of its centre, a loose one links with its leader.
    """
    half = math.acos(least) / 2 - MARGIN
    free, out = np.arange(len(x)), []
    while len(free) >= BALL:
        dots = x[free] @ x[free[0]]
        near = free[dots >= least + MARGIN]
        if len(near) < BALL:
            free = free[1:]
            continue
        c = x[near].mean(axis=0)
        c /= np.linalg.norm(c)
        tight = x[free] @ c >= math.cos(half)
        if tight.sum() >= BALL and tight.sum() >= len(near) // 2:
            out.append((free[tight], c, True))
            free = free[~tight]
        else:
            out.append((near, x[free[0]], False))
            free = free[dots < least + MARGIN]
    return out


def _batch(names, *arrays):
    return pa.RecordBatch.from_arrays([a if isinstance(a, (pa.Array, pa.ChunkedArray)) else pa.array(a) for a in arrays], names.split())


def _raw(x: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in x], pa.binary())


def _grouped(width: int, least: float):
    """Members (rep, w, v, ent, inner) of groups and single vectors, from rows sorted by cell; inner is a vector's links inside its group."""

    def run(batches):
        for part in groups_in(batches, 1, BLOCK):
            rep, w = part.column(2).to_numpy(), part.column(3).to_numpy()
            ent, radius, inner = rep.copy(), np.zeros(len(rep)), w - 1
            u = unit(stack(part.column(4), width))
            centre = u.copy()
            for ball, c, tight in balls_in(u, least):
                ent[ball], centre[ball] = rep[ball].min(), c
                radius[ball] = np.arccos(np.clip(u[ball] @ c, -1, 1)).max() + MARGIN / 4
                if tight:
                    inner[ball] = w[ball].sum() - 1
                else:
                    linked = u[ball] @ u[ball].T >= least
                    np.fill_diagonal(linked, True)
                    inner[ball] = linked @ w[ball] - 1
            yield _batch("rep w v ent inner centre radius", part.column(2), part.column(3), part.column(4), ent, inner, _raw(centre), radius)

    return run


def _windows(reach: float):
    """Colliding pairs (a < b) of each cell's intervals, from rows sorted by list, cell and lower end."""

    def run(batches):
        for g in groups_in(batches, 2):
            if g.num_rows < 2:
                continue
            ent, lo, hi = (g.column(i).to_numpy() for i in (2, 3, 4))
            ends = np.searchsorted(lo, hi + reach, "right")
            for at in range(0, len(ent), 4096):
                rows = np.arange(at, min(at + 4096, len(ent)))
                sizes = np.maximum(ends[rows] - rows - 1, 0)
                i = np.repeat(rows, sizes)
                if len(i):
                    j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                    yield _batch("a b", np.minimum(ent[i], ent[j]), np.maximum(ent[i], ent[j]))

    return run


def near_vectors(table: DataFrame, least: float = 0.95, recall: float = 0.995, seed: int = 5) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    spark = table.sparkSession
    n = shuffle_partitions(spark)
    width = common_width(table)

    def read(batches):
        for batch in batches:
            keep, x = parse(batch.column(1), width) if width else (np.zeros(batch.num_rows, bool), np.zeros((0, 1)))
            raw = np.full(batch.num_rows, None, object)
            raw[keep] = [r.tobytes() for r in x]
            yield _batch("vec_id v", batch.column(0), pa.array(raw.tolist(), pa.binary()))

    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(F.col("vec_id").isNotNull(), F.col("embedding").cast("array<double>")).alias("embedding"))
    rows, _ = cut(rows.mapInArrow(read, "vec_id long, v binary"), "near-rows")
    # Equal vectors are one: its id the smallest vec_id, its weight their number.
    reps, p_reps = cut(rows.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("w")), "near-reps")
    total = reps.count()
    cells, lists, count, near = calibrate(total, least, recall)
    shared = spark.sparkContext.broadcast(Lists(max(1, width), cells, lists, near, seed))

    def coarse(batches):
        for batch in batches:
            if batch.num_rows:
                u, own = unit(stack(batch.column(0), width)), shared.value
                yield _batch("cell at rep w v", own.cells(u, 0, -(-cells // 3)), u @ own.order[:, 0], batch.column(1), batch.column(2), batch.column(0))

    # Ranges of (cell, place) split a cell of many vectors over tasks, neighbours together.
    celled = reps.select("v", "rep", "w").mapInArrow(coarse, "cell long, at double, rep long, w long, v binary")
    sorted_ = celled.repartitionByRange(n, "cell", "at", "rep").sortWithinPartitions("cell", "at", "rep")
    members, p_members = cut(sorted_.mapInArrow(_grouped(width, least), "rep long, w long, v binary, ent long, inner long, centre binary, radius double"), "near-members")
    ents, p_ents = cut(members.groupBy("ent").agg(F.sum("w").alias("m"), F.max("radius").alias("radius"), F.first("centre").alias("centre"), F.count("*").alias("n")), "near-entities")

    def place(batches):
        own = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            u = unit(stack(batch.column(1), width))
            at = u @ own.order
            for k in range(lists):
                yield _batch("list cell ent at", np.full(len(u), k, np.int32), own.cells(u, k), batch.column(0), np.ascontiguousarray(at[:, k]))

    placed = members.select("ent", "v").mapInArrow(place, "list int, cell long, ent long, at double")
    runs = placed.groupBy("list", "cell", "ent").agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    runs = runs.repartition(n, "list", "cell").sortWithinPartitions("list", "cell", "lo")
    met = runs.mapInArrow(_windows(WINDOW * near), "a long, b long").groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= count)
    one, two = (ents.select(F.col("ent").alias(e), F.col("m").alias(f"m_{e}"), F.col("radius").alias(f"r_{e}"), F.col("centre").alias(f"c_{e}")) for e in "ab")

    def decide(batches):
        angle = math.acos(least)
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = stack(batch.column(4), width), stack(batch.column(5), width)
            dot = (x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))
            phi, wide = np.arccos(np.clip(dot, -1, 1)), batch.column(6).to_numpy() + batch.column(7).to_numpy()
            whole = np.where(wide == 0, dot >= least, phi + wide <= angle - MARGIN)
            open_ = (wide > 0) & ~whole & (phi - wide <= angle + MARGIN)
            kept = pa.array(whole | open_)
            yield _batch("a b m_a m_b whole", *(batch.column(i).filter(kept) for i in range(4)), pa.array(whole).filter(kept))

    pairs = met.join(one, "a").join(two, "b")
    decided, p_decided = cut(pairs.select("a", "b", "m_a", "m_b", "c_a", "c_b", "r_a", "r_b").mapInArrow(decide, "a long, b long, m_a long, m_b long, whole boolean"), "near-decided")

    # Pairs of balls that their centres leave open are compared member by member, block by block.
    blocks = members.join(decided.where("not whole").select(F.explode(F.array("a", "b")).alias("ent")).distinct(), "ent", "left_semi")
    blocks = blocks.select("ent", "rep", "w", "v").join(ents.select("ent", "n"), "ent").withColumn("part", F.pmod(F.xxhash64("rep"), F.ceil(F.col("n") / BLOCK)))
    blocks, p_blocks = cut(blocks.groupBy("ent", "part").agg(F.sort_array(F.collect_list(F.struct("rep", "w", "v"))).alias("rows")), "near-blocks")

    def compare(batches):
        for batch in batches:
            for a, b, x, y in zip(*(c.to_pylist() for c in batch.columns)):
                u, v = (np.frombuffer(b"".join(r["v"] for r in rows_), np.float64).reshape(-1, width) for rows_ in (x, y))
                hit = (u @ v.T) / (np.linalg.norm(u, axis=1)[:, None] * np.linalg.norm(v, axis=1)) >= least
                wx, wy = np.array([r["w"] for r in x]), np.array([r["w"] for r in y])
                got = [(r["rep"], int(c)) for r, c in zip(x, hit @ wy) if c] + [(r["rep"], int(c)) for r, c in zip(y, hit.T @ wx) if c]
                if got:
                    yield _batch("a b rep links", np.full(len(got), a), np.full(len(got), b), pa.array([g[0] for g in got]), pa.array([g[1] for g in got]))

    left = blocks.select(F.col("ent").alias("a"), F.col("rows").alias("x"))
    right = blocks.select(F.col("ent").alias("b"), F.col("rows").alias("y"))
    opened = decided.where("not whole").select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y")
    some, p_some = cut(opened.mapInArrow(compare, "a long, b long, rep long, links long"), "near-some")

    whole = decided.where("whole")
    by_ent = whole.select(F.col("a").alias("ent"), F.col("m_b").alias("links")).union(whole.select(F.col("b").alias("ent"), F.col("m_a").alias("links"))).groupBy("ent").agg(F.sum("links").alias("beside"))
    by_rep = some.groupBy("rep").agg(F.sum("links").alias("some"))
    classes, p_classes = components(whole.select("a", "b").union(some.select("a", "b")), "near")
    named = members.select("rep", "ent", "inner", "v").join(by_ent, "ent", "left").join(by_rep, "rep", "left").join(classes.select(F.col("node").alias("ent"), "component"), "ent", "left")
    named = named.select("v", (F.col("inner") + F.coalesce("beside", F.lit(0)) + F.coalesce("some", F.lit(0))).alias("links"), F.coalesce("component", "ent").alias("component"))
    named, _ = cut(named, "near-named")
    forget(spark, p_reps, p_members, p_ents, p_decided, p_blocks, p_some, p_classes)
    out = rows.join(named, "v", "left").select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
