"""Best-fit packing of token documents into sequences of bounded length, in bulk-synchronous rounds.

Documents are cut into pieces of at most `room` ids, the first piece being the short one. A piece
of more than half the room opens a sequence of its own; the rest go in classes of falling
length, each within a factor of SPAN. A round of a class

1. range-sorts its pieces by length together with the gaps by room. A gap that takes several of the
   class's longest pieces offers as many slots; of equal slots those of tighter gaps come first;
2. sweeps each range upward, on its own: a slot takes the longest piece below it that no earlier slot
   took, so a piece goes to its successor, the tightest slot that holds it;
3. resolves what is left across ranges by rank: a range's slots and pieces without a partner get the
   level of the whole sweep's stack at which they would pop or push, from two counts a range; in
   range order a push that a pop of its level follows is a pair;
4. takes the placed pieces off their gaps, and writes gaps, pieces left and placements as tables.

What surely fits no gap opens sequences: as many as its ids need beyond the gaps' room. Rounds repeat
until the class is placed; once its pieces and gaps are one range, one task goes through the rounds
that are left. The driver holds counts alone; a task holds one range.

Null texts are empty documents (the end id alone); repeated rows are packed each by itself;
an empty table gives no rows; other columns, of any name, are left out.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, forget, text_slices, texts_of, trim
from .tokens import encoder

SPAN = 4
#: Rows a range of a round aims at.
RANGE = 1 << 18
PAIR, PIECE, SLOT = 0, 1, 2


def cut_pieces(docs: DataFrame, tokenizer: str, room: int = 2048, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece, with pid, a number of its own."""

    def pieces(batches):
        bpe, pid = encoder(tokenizer), TaskContext.get().partitionId() << 40
        for batch in batches:
            for at, texts in text_slices(batch.column(1)):
                out = []
                for doc, raw in zip(batch.column(0).slice(at, len(texts)).to_pylist(), bpe.encode(texts)):
                    ids = np.append(np.frombuffer(raw, bpe.kind), bpe.kind.type(end_id)).astype("<u4")
                    a, k = 0, 0
                    while a < len(ids):
                        b = a + ((len(ids) - a - 1) % room + 1)
                        out.append((doc, k, a, b - a, zlib.crc32(ids[a:b]), pid))
                        a, k, pid = b, k + 1, pid + 1
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["doc_id", "piece", "start", "length", "ids_crc32", "pid"])
        trim()  # the encoder stays for the worker's next task

    return texts_of(docs).mapInArrow(pieces, "doc_id long, piece int, start long, length long, ids_crc32 long, pid long")


def match(slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of matched (piece, slot) rows of a sweep; rows are in order, slot tells which are slots.

    Pieces are pushed on a stack and slots pop it. The k-th push of a level and the pop that
    follows it at that level are a pair, so one sort by level finds all.
    """
    height = np.cumsum(np.where(slot, -1, 1))
    order = np.argsort(np.where(slot, height + 1, height), kind="stable")
    level = np.where(slot, height + 1, height)[order]
    pairs = np.flatnonzero((level[1:] == level[:-1]) & ~slot[order[:-1]] & slot[order[1:]])
    return order[pairs], order[pairs + 1]


def _columns(batches):
    table = pa.Table.from_batches(batches) if (batches := list(batches)) else None
    return None if table is None or not table.num_rows else [c.to_numpy() for c in table.columns]


def _sweep(turn: int):
    """One range of sorted items: its pairs, and what has no partner, numbered in order."""

    def run(batches):
        part, got = TaskContext.get().partitionId(), _columns(batches)
        if got is None:
            return
        size, kind, _, item, nth = got
        slot = kind == 1
        a, b = match(slot)
        alone = np.ones(len(size), bool)
        alone[a] = alone[b] = False
        for rows, code in ((np.flatnonzero(alone & ~slot), PIECE), (np.flatnonzero(alone & slot), SLOT)):
            n, none = len(rows), np.zeros(len(rows), np.int64)
            yield _rows(np.full(n, code), np.full(n, part), np.arange(n), *((item[rows], size[rows], none, none) if code == PIECE else (none, none, item[rows], nth[rows])))
        yield _rows(np.full(len(a), PAIR), np.full(len(a), part), np.arange(len(a)), item[a], size[a], item[b], nth[b] + (turn << 40))

    return run


def openings(ids: int, free: int, fits: int | None, room: int) -> int:
    """Sequences to open for so many ids left: what the gaps' room falls short by, or all if no piece has found a gap."""
    return max(0, -(-(ids - (free if fits != 0 else 0)) // room))


def _finish(turn: int, room: int, opened: int):
    """The rounds that are left of a class of one range: all of its pairs."""

    def run(batches):
        got = _columns(batches)
        if got is None:
            return
        size, kind, _, item, _ = got
        order = np.argsort(size[kind == 0], kind="stable")
        left, pid = size[kind == 0][order], item[kind == 0][order]
        gaps, seq = size[kind == 1].copy(), item[kind == 1]
        fits, step, taken = None, 0, opened
        while len(left):
            low, high = left[0], left[-1]
            new = openings(int(left.sum()), int(gaps[gaps >= low].sum()), fits, room)
            gaps, seq, taken = np.append(gaps, np.full(new, room)), np.append(seq, -1 - taken - np.arange(new)), taken + new
            free = np.flatnonzero(gaps >= low)
            each = np.minimum(np.maximum(1, gaps[free] // high), -(-2 * len(left) // max(1, int((gaps >= high).sum()))))
            of = np.repeat(free, each)
            nth = np.arange(len(of)) - np.repeat(np.cumsum(each) - each, each)
            sizes, slot = np.concatenate([left, np.minimum(gaps[of], high)]), np.arange(len(left) + len(of)) >= len(left)
            order = np.lexsort((np.concatenate([np.zeros(len(left), np.int64), gaps[of]]), slot, sizes))
            a, b = match(slot[order])
            a, b = order[a], order[b] - len(left)
            yield _rows(np.full(len(a), PAIR), np.zeros(len(a), int), np.arange(len(a)), pid[a], left[a], seq[of[b]], nth[b] + (step << 24) + (turn << 40))
            np.subtract.at(gaps, of[b], left[a])
            keep = np.ones(len(left), bool)
            keep[a] = False
            left, pid, fits, step = left[keep], pid[keep], len(a), step + 1

    return run


_SWEPT = "kind int, part int, place long, pid long, length long, seq long, slot long"


def _rows(kind, part, place, *rest) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(part, pa.int32()), *(pa.array(x, pa.int64()) for x in (place, *rest))], [c.split()[0] for c in _SWEPT.split(", ")])


def _across(swept: DataFrame, turn: int) -> DataFrame:
    """Swept rows with the pairs that lie in different ranges found too."""
    alone = {r["part"]: (r["u"], r["v"]) for r in swept.groupBy("part").agg(F.count_if(F.col("kind") == SLOT).alias("u"), F.count_if(F.col("kind") == PIECE).alias("v")).collect()}  # two counts a range
    before, starts = 0, []
    for part in sorted(alone):
        u, v = alone[part]
        starts.append((part, before, before - u))
        before += v - u
    starts = F.broadcast(swept.sparkSession.createDataFrame(starts, "part int, before long, after long"))
    level = F.when(F.col("kind") == SLOT, F.col("before") - F.col("place")).otherwise(F.col("after") + F.col("place") + 1)
    rest = swept.where(F.col("kind") != PAIR).join(starts, "part").withColumn("level", level)
    at = Window.partitionBy("level").orderBy("part", F.desc("kind"))  # a range's slots pop before its pieces push
    follows, leads = (f(F.struct("kind", "seq", "slot")).over(at) for f in (F.lead, F.lag))
    rest = rest.withColumn("next", follows).withColumn("last", leads)
    met = F.col("next.kind") == SLOT
    rest = rest.where((F.col("kind") == PIECE) | F.col("last.kind").isNull() | (F.col("last.kind") != PIECE))
    paired = (F.col("kind") == PIECE) & F.coalesce(met, F.lit(False))
    either = lambda c: F.when(paired, F.col(f"next.{c}")).otherwise(F.col(c)).alias(c)
    rest = rest.select(F.when(paired, PAIR).otherwise(F.col("kind")).cast("int").alias("kind"), "part", "place", "pid", "length", either("seq"), F.when(paired, F.col("next.slot") + F.lit(turn << 40)).otherwise(F.col("slot")).alias("slot"))
    return swept.where(F.col("kind") == PAIR).unionByName(rest)


def place(pieces: DataFrame, room: int, per_range: int = RANGE) -> tuple[DataFrame, list[str]]:
    """pid, length, seq of every piece (pid, length), with slot, its order in the sequence; and the scratch paths read."""
    spark = pieces.sparkSession
    half, edges = room // 2, []
    while half and (not edges or edges[-1]):
        edges.append((edges[-1] if edges else half) // SPAN if (edges[-1] if edges else half) > SPAN else 0)
    own = pieces.where(F.col("length") > half).select("pid", "length", F.col("pid").alias("seq"), F.lit(0).cast("long").alias("slot"))
    kept, opened, turn = [], 0, 0
    sizes = F.least(F.lit(len(edges)), F.lit(len(edges)), *[F.when(F.col("length") > lo, i) for i, lo in enumerate(edges)])
    told = [F.count("*").alias("n"), F.sum("length").alias("ids"), F.min("length").alias("low"), F.max("length").alias("high")]
    of_class = {r["c"]: r for r in pieces.where(F.col("length") <= half).groupBy(sizes.alias("c")).agg(*told).collect()}  # a row a class
    gaps, p_gaps = cut(own.where(F.col("length") < room).select("seq", (F.lit(room) - F.col("length")).alias("room")), "packing-gaps")
    for c in sorted(of_class):
        now, fits, most = of_class[c], None, half if not c else edges[c - 1]
        left = pieces.where((F.col("length") > edges[c]) & (F.col("length") <= most)).select("pid", "length")
        while now["n"]:
            turn += 1
            n, low, high = now["n"], now["low"], now["high"]
            free = gaps.where(F.col("room") >= low).agg(F.count("*").alias("n"), F.coalesce(F.sum("room"), F.lit(0)).alias("ids"), F.count_if(F.col("room") >= high).alias("big")).first()
            pieces_ = left.select(F.col("length").alias("size"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("room"), F.col("pid").alias("item"), F.lit(0).cast("long").alias("nth"))
            last = n + free["n"] <= per_range // 4
            if last:
                items = pieces_.union(gaps.where(F.col("room") >= low).select("room", F.lit(1), "room", "seq", F.lit(0).cast("long")))
                swept, p_swept = cut(items.repartition(1).sortWithinPartitions("kind", "size", "item").mapInArrow(_finish(turn, room, opened), _SWEPT), "packing-swept")
            else:
                new = openings(now["ids"], free["ids"], fits, room)
                gaps = gaps.union(spark.range(opened, opened + new).select((-1 - F.col("id")).alias("seq"), F.lit(room).cast("long").alias("room")))
                opened += new
                each = F.least(F.greatest(F.lit(1), F.floor(F.col("room") / high)), F.lit(-(-2 * n // max(1, free["big"] + new)))).cast("long")
                slots = gaps.where(F.col("room") >= low).select("seq", "room", F.explode(F.sequence(F.lit(0).cast("long"), each - 1)).alias("slot"))
                items = pieces_.union(slots.select(F.least("room", F.lit(high).cast("long")).alias("size"), F.lit(1), "room", "seq", "slot"))
                by = ["size", "kind", "room", F.xxhash64("item"), "item", "nth"]
                ranges = max(2, -(-(3 * n + free["n"]) // per_range))
                swept, p_new = cut(items.repartitionByRange(ranges, *by).sortWithinPartitions(*by).mapInArrow(_sweep(turn), _SWEPT), "packing-swept")
                swept, p_swept = cut(_across(swept, turn), "packing-met")
                forget(spark, p_new)
            kept.append(p_swept)
            pairs = swept.where(F.col("kind") == PAIR)
            if last:
                # Sequences that the task opened, numbered on from the others.
                least = pairs.agg(F.min("seq")).first()[0]
                if least < -opened:
                    gaps = gaps.union(spark.range(opened, -least).select((-1 - F.col("id")).alias("seq"), F.lit(room).cast("long").alias("room")))
                    opened = -least
            changed = gaps.union(pairs.select("seq", -F.col("length"))).groupBy("seq").agg(F.sum("room").alias("room")).where("room > 0")
            gaps, p_new = cut(changed, "packing-gaps")
            forget(spark, p_gaps)
            p_gaps = p_new
            if last:
                break
            left = swept.where(F.col("kind") == PIECE).select("pid", "length")
            now = left.agg(*told).first()
            fits = n - now["n"]
    forget(spark, p_gaps)
    if not kept:
        return own, []
    return own.union(spark.read.schema(swept.schema).parquet(*kept).where(F.col("kind") == PAIR).select("pid", "length", "seq", "slot")), kept


def pack(docs: DataFrame, tokenizer: str, room: int = 2048, end_id: int = 0, per_range: int = RANGE) -> DataFrame:
    """Every piece of docs with its sequence_id and offset."""
    pieces, _ = cut(cut_pieces(docs, tokenizer, room, end_id), "packing-pieces")
    placed, paths = place(pieces.select("pid", "length"), room, per_range)
    # A sequence has at most `room` pieces.
    before = F.sum("length").over(Window.partitionBy("seq").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1))
    where = placed.select("pid", F.col("seq").alias("sequence_id"), F.coalesce(before, F.lit(0)).alias("offset"))
    where, _ = cut(where, "packing-places")
    forget(docs.sparkSession, *paths)
    return pieces.join(where, "pid").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
