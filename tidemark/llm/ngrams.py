"""Exact classes of the n-gram Jaccard join, by signature trees.

A document is the set of its distinct five-word shingles (hashed to 64 bits; a text of fewer
words is one shingle). Two documents link when 100 * |x & y| >= 80 * |x | y|. The classes are
exact and no pair is capped, but links are not listed: a pair that other links put into one class
already is not looked at, so the links made are enough to join each class and can't be counted.

1. Documents of equal sets become one set, its id a 64-bit hash. (Among n documents a collision
   has a chance of n^2 / 2^65.)
2. Shingles get a global order: those not listed as frequent by hash, then the frequent ones,
   rarest first. The list holds at most `frequent` shingles, from counts summed over all
   partitions; any list gives the same result, a good one keeps groups small.
3. In that order a set's first n - ceil(0.8 n) + 1 shingles are its prefix; linked sets share
   one. Sets meet in the groups of their prefix shingles; groups of the same members are one.
4. Candidates come from signature trees over a group's sets in order of size: leaves and inner nodes
   hold OR-combined bitmaps of shingles and size ranges, and a dual traversal drops node
   pairs whose sizes or whose maximum possible overlap rule a link out. In the first round the tree of a
   group's lead, its set of most groups, meets the tree of the others, which joins large families in
   linear work; the second round's traversal is of each group's tree with itself, and also drops
   node pairs that lie in one class already. Families and groups of many sets are dealt out in parts.
5. Surviving pairs are verified on the whole sets, the lead's being sent once for each part.

Null texts are empty; an empty text, or one without words, has no shingles and links with
nothing. Repeated rows are documents of their own in one class. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import components, cut, forget, fresh_worker, release, shuffle_partitions, text_slices, texts_of, trim

WORDS = 5
_C = np.uint64(0x9E3779B97F4A7C15)
#: Sets of a family, or rows of a group, that joins and trees take as one key; rows of a token held to see which groups are equal.
PART, HELD = 256, 1 << 20
#: Bytes of text shingled at once, which take about ten times as much.
TEXT = 1 << 21


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_sets(texts: list[str], words: int = WORDS) -> list[np.ndarray]:
    """Each text's distinct shingles, hashed and sorted."""
    if not texts:
        return []
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(texts, pa.large_string())))
    offsets, coded = np.asarray(lists.offsets), lists.values.dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in distinct), np.uint64, len(distinct))
    codes = np.asarray(coded.indices)
    real = np.fromiter(map(bool, distinct), bool, len(distinct))[codes] if distinct else np.zeros(0, bool)
    before = np.concatenate([[0], np.cumsum(real)])
    w, offsets = hashes[codes[real]], before[offsets]
    rolled = np.zeros(max(0, len(w) - words + 1), np.uint64)
    for k in range(words):
        rolled = rolled * _C + w[k : k + len(rolled)]
    rolled = mix(rolled)
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if b - a >= words:
            out.append(np.unique(rolled[a : b - words + 1]))
        elif b > a:
            h = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for x in w[a:b]:
                    h = h * _C + x
            out.append(mix(np.array([h], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_id(s: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).astype(np.int64))


def needed(n: int) -> int:
    """The least overlap of a set of n shingles with any set it links with."""
    return -(-4 * n // 5)


def signature(s: np.ndarray) -> bytes:
    """A bitmap of the shingles: two to four bits for each, at most 4 KiB."""
    bits = min(1 << 15, max(64, 1 << int(2 * len(s) - 1).bit_length()))
    out = np.zeros(bits // 64, np.uint64)
    at = s & np.uint64(bits - 1)
    np.bitwise_or.at(out, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    return out.tobytes()


def fold(sig: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps (rows) ORed down to so many 64-bit words."""
    while sig.shape[-1] > words:
        half = sig.shape[-1] // 2
        sig = sig[..., :half] | sig[..., half:]
    return sig


class Tree:
    """Sets in order of size; level 0 has single sets, each level above nodes of FAN.

    A level holds its nodes' least and largest size, the most shingles by which a set exceeds
    its bitmap's bits, the ORed bitmaps, and the class all sets are of, or -1.
    """

    FAN = 8

    def __init__(self, ids, n, sig, comp):
        excess = n - np.bitwise_count(sig).sum(axis=-1).astype(np.int64)
        self.ids, self.levels = ids, [(n, n, excess, sig, comp)]
        while len(self.levels[-1][0]) > 1:
            lo, hi, ex, bits, own = self.levels[-1]
            at = np.arange(0, len(lo), self.FAN)
            same = np.minimum.reduceat(own, at) == np.maximum.reduceat(own, at)
            self.levels.append((np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(ex, at), np.bitwise_or.reduceat(bits, at, axis=0), np.where(same, np.minimum.reduceat(own, at), -1)))

    def children(self, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nodes one level down, and which of `nodes` each belongs to."""
        size = len(self.levels[level - 1][0])
        down = nodes[:, None] * self.FAN + np.arange(self.FAN)
        ok = down < size
        return down[ok], np.broadcast_to(np.arange(len(nodes))[:, None], down.shape)[ok]


def traverse(x: Tree, y: Tree) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs of sets of two trees that sizes, bitmaps and classes don't rule out.

    Both trees are descended level by level; the pairs alive at a level are tested at once.
    """
    own = x is y
    i = j = np.zeros(1, np.int64)
    li, lj = len(x.levels) - 1, len(y.levels) - 1
    while True:
        keep = _possible(x.levels[li], y.levels[lj], i, j)
        i, j = i[keep], j[keep]
        if not len(i) or not (li or lj):
            break
        if li >= lj and li:
            down, of = x.children(li, i)
            i, j, li = down, j[of], li - 1
        if lj > li:
            down, of = y.children(lj, j)
            j, i, lj = down, i[of], lj - 1
        if own and li == lj:
            i, j = i[i <= j], j[i <= j]
    if own:
        i, j = i[i < j], j[i < j]
    return i, j


def _possible(a, b, i, j, step: int = 1 << 16) -> np.ndarray:
    keep = np.zeros(len(i), bool)
    for at in range(0, len(i), step):
        p, q = i[at : at + step], j[at : at + step]
        sizes = (5 * a[1][p] >= 4 * b[0][q]) & (5 * b[1][q] >= 4 * a[0][p]) & ~((a[4][p] == b[4][q]) & (a[4][p] >= 0))
        rows = np.flatnonzero(sizes)
        if len(rows):
            p, q = p[rows], q[rows]
            overlap = np.bitwise_count(a[3][p] & b[3][q]).sum(axis=-1).astype(np.int64) + np.minimum(a[2][p], b[2][q])
            most = np.minimum(np.minimum(overlap, a[1][p]), b[1][q])
            keep[at + rows[9 * most >= 4 * (a[0][p] + b[0][q])]] = True
    return keep


def candidate_pairs(ids, n, sigs, comp, side=None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a group's sets (ids a < b) that the signature trees don't rule out.

    side: 0 or 1 where the group is a pair of blocks, so that only pairs across count.
    """
    width = np.array([len(s) // 8 for s in sigs])
    order = np.lexsort((ids, n))
    out_a, out_b = [], []
    trees = {}

    def tree(w, s, to):
        if (w, s, to) not in trees:
            rows = order[(width[order] == w) & ((side[order] == s) if side is not None else True)]
            trees[w, s, to] = Tree(rows, n[rows], fold(np.stack([np.frombuffer(sigs[r], np.uint64) for r in rows]), to), comp[rows]) if len(rows) else None
        return trees[w, s, to]

    widths = sorted(set(width.tolist()))
    for w in widths:
        for v in (w, 2 * w):
            if v not in widths:
                continue
            for s, t in ((None, None),) if side is None else ((0, 1),) if v == w else ((0, 1), (1, 0)):
                x, y = tree(w, s, w), tree(v, t, w)
                if x is None or y is None:
                    continue
                i, j = traverse(x, y)
                out_a.append(x.ids[i])
                out_b.append(y.ids[j])
    if not out_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = ids[np.concatenate(out_a)], ids[np.concatenate(out_b)]
    return np.minimum(a, b), np.maximum(a, b)


def _batch(names: str, *arrays) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([a if isinstance(a, pa.Array) else pa.array(a) for a in arrays], names.split())


def groups_in(batches, keys: int, most: int = 1 << 62):
    """Runs of rows with equal first `keys` columns, as RecordBatches of at most `most` rows, from sorted batches."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if rest is not None:
            batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
        change = np.zeros(batch.num_rows, bool)
        for k in range(keys):
            col = batch.column(k).to_numpy(zero_copy_only=False)
            change[1:] |= col[1:] != col[:-1]
        cuts = np.flatnonzero(change).tolist()
        for a, b in zip([0, *cuts], cuts):
            for at in range(a, b, most):
                yield batch.slice(at, min(most, b - at))
        rest = batch.slice(cuts[-1] if cuts else 0)
        while rest.num_rows > most:
            yield rest.slice(0, most)
            rest = rest.slice(most)
    if rest is not None:
        yield rest


def frequent_shingles(docs: DataFrame, most: int, each: int = 1 << 15) -> np.ndarray:
    """At most `most` shingles of the highest counts, rarest last; each partition names its `each` most frequent."""

    def count(batches):
        held, size, seen = [], 0, set()
        known = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        fresh_worker()

        def settle(known):
            s, c = np.unique(np.concatenate(held), return_counts=True) if held else known
            both = np.concatenate([known[0], s]) if held else s
            if held:
                u, inv = np.unique(both, return_inverse=True)
                total = np.bincount(inv, np.concatenate([known[1], c]), len(u)).astype(np.int64)
                top = np.argsort(-total, kind="stable")[: 32 * each]
                return u[top], total[top]
            return known

        for batch in batches:
            for _, part in text_slices(batch.column(0), TEXT):
                for s in shingle_sets(part):
                    own = set_id(s)
                    if own not in seen:
                        seen.add(own)
                        held.append(s)
                        size += len(s)
                if size > 1 << 20:
                    known, size = settle(known), 0
                    held.clear()
        s, c = settle(known)
        top = np.argsort(-c, kind="stable")[:each]
        top = top[c[top] > 1]
        yield _batch("shingle n", s[top].astype(np.int64), c[top])
        seen.clear()
        trim()

    counted = texts_of(docs).select("text").mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    # At most `most` rows of two numbers.
    best = counted.where("n >= 8").orderBy(F.desc("n"), "shingle").limit(most).collect()
    return np.array([r["shingle"] for r in best], np.int64).astype(np.uint64)


def in_order(s: np.ndarray, listed: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """A set in the global order: shingles not listed by hash, then listed ones by rank. listed is sorted."""
    if not len(listed):
        return s
    at = np.minimum(np.searchsorted(listed, s), len(listed) - 1)
    hit = listed[at] == s
    return np.concatenate([s[~hit], s[hit][np.argsort(rank[at[hit]], kind="stable")]])


def _prepare(docs: DataFrame, frequent: int) -> tuple[DataFrame, str]:
    """doc_id, n, sid of every document; bitmap and prefix of a task's first document of each set, else null."""
    common = frequent_shingles(docs, frequent)
    order = np.argsort(common)
    listed, rank = common[order], (-np.arange(len(common)))[order]

    def prepare(batches):
        seen = set()
        fresh_worker()
        for batch in batches:
            for at, part in text_slices(batch.column(1), TEXT):
                sets = shingle_sets(part)
                ids, sigs, prefixes = [set_id(s) for s in sets], [], []
                for own, s in zip(ids, sets):
                    first = own not in seen and len(s)
                    seen.add(own)
                    sigs.append(signature(s) if first else None)
                    prefixes.append(in_order(s, listed, rank)[: len(s) - needed(len(s)) + 1].tobytes() if first else None)
                yield _batch("doc_id n sid sig prefix", batch.column(0).slice(at, len(part)), pa.array([len(s) for s in sets], pa.int64()), pa.array(ids, pa.int64()), pa.array(sigs, pa.binary()), pa.array(prefixes, pa.binary()))
        seen.clear()
        trim()

    return cut(texts_of(docs).mapInArrow(prepare, "doc_id long, n long, sid long, sig binary, prefix binary"), "ngram-sets")


def _groups(prepared: DataFrame, held: int = HELD) -> DataFrame:
    """(gid, c, sid) of groups of two or more sets that share a prefix shingle, in parts c of PART sets; equal groups are one."""

    def explode(batches):
        for batch in batches:
            sizes, sid = [len(x) // 8 for x in batch.column(1).to_pylist()], batch.column(0).to_numpy()
            yield _batch("token sid", np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64), np.repeat(sid, sizes))

    def settle(t, s):
        """Whole runs of tokens."""
        new = np.ones(len(t), bool)
        new[1:] = (t[1:] != t[:-1]) | (s[1:] != s[:-1])
        t, s = t[new], s[new]
        starts = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        sizes = np.diff(np.append(starts, len(t)))
        gid = np.add.reduceat(mix(s.astype(np.uint64)), starts) + mix(sizes.astype(np.uint64))
        _, first = np.unique(gid, return_index=True)
        once = np.zeros(len(gid), bool)
        once[first] = True
        rows = np.repeat((sizes > 1) & once, sizes)
        place = np.arange(len(t)) - np.repeat(starts, sizes)
        return _batch("gid c sid", np.repeat(gid, sizes)[rows].astype(np.int64), place[rows] // PART, s[rows])

    def meet(batches):
        rest_t = rest_s = np.zeros(0, np.int64)
        long, at = None, 0  # a token of more rows than are held, and how many of them were let go
        for batch in batches:
            t, s = np.concatenate([rest_t, batch.column(0).to_numpy()]), np.concatenate([rest_s, batch.column(1).to_numpy()])
            if long is not None:
                own = int(np.searchsorted(t != long, True))
                yield _batch("gid c sid", np.full(own, long), (at + np.arange(own)) // PART, s[:own])
                t, s, at = t[own:], s[own:], at + own
                if len(t):
                    long = None
            if not len(t):
                rest_t = rest_s = np.zeros(0, np.int64)
                continue
            last = len(t) - int(np.searchsorted(t[::-1] != t[-1], True))
            if last:
                yield settle(t[:last], s[:last])
            rest_t, rest_s = t[last:], s[last:]
            if len(rest_t) > held:
                long, at = rest_t[0], len(rest_t)
                yield _batch("gid c sid", rest_t, np.arange(at) // PART, rest_s)
                rest_t = rest_s = np.zeros(0, np.int64)
        if len(rest_t):
            yield settle(rest_t, rest_s)
        trim()

    spark = prepared.sparkSession
    tokens = prepared.where("prefix is not null").select("sid", "prefix").mapInArrow(explode, "token long, sid long")
    met = tokens.repartition(shuffle_partitions(spark), "token").sortWithinPartitions("token", "sid").mapInArrow(meet, "gid long, c long, sid long")
    return met.dropDuplicates(["gid", "sid"])


def _verify(docs: DataFrame, prepared: DataFrame, pairs: DataFrame, label: str, bound: int = 1 << 20) -> tuple[DataFrame, str]:
    """(a, b) of the pairs of sets (hub, ch, sid) that link, by the whole sets of their documents.

    A task holds one hub's set and meets the others of a part ch with it as they come. Shingles are made again, from those documents' texts alone, instead of kept for all. The
    documents' ids are broadcast up to `bound`; beyond, documents meet them in a join.
    """
    wanted = pairs.select(F.explode(F.array("hub", "sid")).alias("sid")).distinct()
    named = prepared.where("sig is not null").select("sid", "doc_id").join(wanted, "sid", "left_semi").groupBy("sid").agg(F.min("doc_id").alias("_id"))
    named, p_named = cut(named.select("_id").distinct(), f"{label}-wanted")
    if named.count() <= bound:
        named = F.broadcast(named)
    chosen = texts_of(docs)
    chosen = chosen.join(named, chosen["doc_id"].eqNullSafe(named["_id"]), "left_semi")

    def make(batches):
        seen = set()
        for batch in batches:
            for _, part in text_slices(batch.column(0), TEXT):
                found = {set_id(s): s for s in shingle_sets(part)}
                new = [i for i in found if i not in seen]
                seen.update(new)
                yield _batch("sid shingles", pa.array(new, pa.int64()), pa.array([found[i].tobytes() for i in new], pa.binary()))

    sets, p_sets = cut(chosen.select("text").mapInArrow(make, "sid long, shingles binary"), f"{label}-sets")

    def check(batches):
        of, hub = None, None
        for batch in batches:
            a, b, keep = batch.column(0).to_numpy(), batch.column(3).to_numpy(), np.zeros(batch.num_rows, bool)
            for i, (kind, raw) in enumerate(zip(batch.column(2).to_pylist(), batch.column(4).to_pylist())):
                t = np.frombuffer(raw, np.uint64)
                if kind == 0:
                    of, hub = a[i], t
                elif of == a[i]:
                    both = np.sort(np.concatenate([hub, t]), kind="stable")
                    common = int((both[1:] == both[:-1]).sum())
                    keep[i] = 100 * common >= 80 * (len(hub) + len(t) - common)
            yield _batch("a b", np.minimum(a, b)[keep], np.maximum(a, b)[keep])

    others = pairs.join(sets, "sid").select("hub", "ch", F.lit(1).alias("kind"), "sid", "shingles")
    hubs = pairs.select("hub", "ch").distinct().join(sets, F.col("hub") == F.col("sid")).select("hub", "ch", F.lit(0).alias("kind"), "sid", "shingles")
    met = hubs.union(others).repartition(shuffle_partitions(docs.sparkSession), "hub", "ch").sortWithinPartitions("hub", "ch", "kind")
    links, path = cut(met.mapInArrow(check, "a long, b long"), f"{label}-links")
    forget(docs.sparkSession, p_named, p_sets)
    return links, path


def jaccard_links(docs: DataFrame, frequent: int = 1 << 18, block: int = 2048, held: int = HELD) -> tuple[DataFrame, DataFrame, list[str]]:
    """Documents (doc_id, n, sid), links (a, b) between sets that join every class, and the scratch paths they read."""
    spark = docs.sparkSession
    prepared, p_prepared = _prepare(docs, frequent)
    groups, p_groups = cut(_groups(prepared, held), "ngram-groups")
    release(spark)
    members = groups.select("sid").distinct()
    wide = prepared.where("sig is not null").select("sid", "n", "sig").join(members, "sid", "left_semi").dropDuplicates(["sid"])
    wide, p_wide = cut(wide, "ngram-members")
    n = shuffle_partitions(spark)
    # A group's lead is its set of most groups: the original of a family rather than one of its edited copies.
    degree = groups.groupBy("sid").agg(F.count("*").alias("degree"))
    lead = F.max(F.struct("degree", "sid"))["sid"]
    sizes = groups.join(degree, "sid").groupBy("gid").agg(F.count("*").alias("size"), F.max("c").alias("top"), lead.alias("lead")).where("size > 1")
    sizes, p_sizes = cut(sizes, "ngram-sizes")
    # Joins on a group go by its parts, so that no key has more rows than a part.
    by_part = sizes.withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), "top")))
    parts = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.lit(1.0), F.col("size") / PART)))).cast("long")
    own = groups.join(by_part, ["gid", "c"]).where("sid <> lead").select(F.col("lead").alias("hub"), F.pmod(F.xxhash64("sid"), parts).alias("ch"), "sid").distinct()
    own, p_own = cut(own, "ngram-families")
    heads = own.select("hub", "ch").distinct().join(wide, F.col("hub") == F.col("sid")).select("hub", "ch", F.lit(0).alias("kind"), "sid", "n", "sig")
    family = heads.union(own.join(wide, "sid").select("hub", "ch", F.lit(1).alias("kind"), "sid", "n", "sig"))

    def meet_lead(batches):
        for g in groups_in(batches, 2):
            hub, ch, kind, sid, size, sig = (g.column(k) for k in range(6))
            ids = sid.to_numpy()
            a, b = candidate_pairs(ids, size.to_numpy(), sig.to_pylist(), np.arange(len(ids)), kind.to_numpy())
            one = hub[0].as_py()
            yield _batch("hub ch sid", np.full(len(a), one), np.full(len(a), ch[0].as_py(), np.int64), np.where(a == one, b, a))

    pairs = family.repartition(n, "hub", "ch").sortWithinPartitions("hub", "ch", "kind").mapInArrow(meet_lead, "hub long, ch long, sid long")
    pairs, p_pairs = cut(pairs, "ngram-pairs")
    links, p_links = _verify(docs, prepared, pairs, "ngram-first")
    classes, p_classes = components(links, "ngram-first")

    def descend(batches):
        held = []

        def once():
            pairs_ = np.unique(np.concatenate(held), axis=0)
            held.clear()
            return _batch("a b", np.ascontiguousarray(pairs_[:, 0]), np.ascontiguousarray(pairs_[:, 1]))

        for g in groups_in(batches, 3):
            _, i, j, side, sid, size, sig, comp = (g.column(k) for k in range(8))
            cross = i[0].as_py() != j[0].as_py()
            _, classes_ = np.unique(comp.to_numpy(), return_inverse=True)
            a, b = candidate_pairs(sid.to_numpy(), size.to_numpy(), sig.to_pylist(), classes_, side.to_numpy() if cross else None)
            held.append(np.stack([a, b], axis=1))
            if sum(map(len, held)) > 1 << 18:
                yield once()
        if held:
            yield once()

    k = F.ceil(F.col("size") / block).cast("int")
    left = groups.join(by_part.where("size > 2"), ["gid", "c"]).withColumn("k", k).withColumn("b", F.pmod(F.xxhash64("sid"), "k").cast("int"))
    left = left.join(classes.select(F.col("node").alias("sid"), "component"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    # Groups whose sets are of one class need no second look.
    open_groups = left.groupBy("gid").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.max("top").alias("top")).where("lo <> hi")
    open_groups = open_groups.select("gid", F.explode(F.sequence(F.lit(0).cast("long"), "top")).alias("c"))
    left = left.join(open_groups, ["gid", "c"], "left_semi").join(wide, "sid")
    dealt = left.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).select("gid", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), F.when(F.col("b") > F.col("o"), 1).otherwise(0).alias("side"), "sid", "n", "sig", "component")
    more = dealt.repartition(n, "gid", "i", "j").sortWithinPartitions("gid", "i", "j").mapInArrow(descend, "a long, b long").distinct()
    more, p_more = cut(more, "ngram-more")
    more = more.select(F.col("a").alias("hub"), F.pmod(F.xxhash64("b"), F.lit(64)).alias("ch"), F.col("b").alias("sid"))
    second, p_second = _verify(docs, prepared, more, "ngram-second")
    forget(spark, p_groups, p_wide, p_sizes, p_own, p_pairs, p_more, p_classes)
    return prepared.select("doc_id", "n", "sid"), links.union(second), [p_prepared, p_links, p_second]


def _roots(docs: DataFrame, **options) -> tuple[DataFrame, DataFrame, str]:
    """Documents (doc_id, n, sid), each set's smallest doc_id and class (sid, least, root), and the latter's scratch path."""
    rows, links, paths = jaccard_links(docs, **options)
    classes, p_classes = components(links, "ngram")
    own = rows.where("n > 0").groupBy("sid").agg(F.min("doc_id").alias("least"))
    joined = own.join(classes.select(F.col("node").alias("sid"), F.col("component").alias("root")), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    joined, p_joined = cut(joined, "ngram-roots")
    forget(docs.sparkSession, p_classes, *paths[1:])
    return rows, joined, p_joined


def ngram_classes(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links) of every document."""
    rows, joined, p_joined = _roots(docs, **options)
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    named, _ = cut(joined.join(least, "root").select("sid", "component_id"), "ngram-named")
    forget(docs.sparkSession, p_joined)
    out = rows.join(named, "sid", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, bound: int = 1 << 20, **options) -> DataFrame:
    """One row of each class, with all its columns; rows without words, which link with nothing, stay.

    The row is of the smallest doc_id, null being the largest, and of its sets the one of smallest
    hash; of several such rows, the one whose columns have the smallest hash. Where doc_id names one
    row it decides alone. Only rows of a repeated or null doc_id get their shingles made again.
    Ids to leave out or look at again are broadcast up to `bound`; beyond, documents meet them in a join.
    """
    rows, roots, p_roots = _roots(docs, **options)
    best = roots.groupBy("root").agg(F.min(F.struct(F.col("least").isNull().alias("none"), "least", "sid")).alias("best"))
    best, _ = cut(best.select("best.sid", "best.least"), "ngram-best")
    stays = (F.col("n") == 0) | F.coalesce(F.col("chosen") & F.col("doc_id").eqNullSafe(F.col("least")), F.lit(False))
    marked = rows.join(best.withColumn("chosen", F.lit(True)), "sid", "left").select("doc_id", stays.alias("stays"))
    ids = marked.groupBy(F.col("doc_id").alias("_id")).agg(F.min("stays").alias("stays"), (F.count("*") > 1).alias("again"))
    ids = ids.select("_id", (F.col("again") | F.col("_id").isNull()).alias("again"), "stays").where("again or not stays").select("_id", "again")
    ids, _ = cut(ids, "ngram-out")
    forget(docs.sparkSession, p_roots)
    seen = ids.agg(F.count("*"), F.count_if("again")).first()
    if seen[0] <= bound:
        ids = F.broadcast(ids)
    once = docs.join(ids, docs["doc_id"].cast("long") == ids["_id"], "left_anti")
    if not seen[1]:
        return once

    def name(batches):
        for batch in batches:
            for at, part in text_slices(batch.column(2), TEXT):
                sids = [set_id(x) if len(x) else None for x in shingle_sets(part)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), batch.column(1).slice(at, len(part)), pa.array(sids, pa.int64())], ["row", "id", "sid"])

    doc_id = docs["doc_id"].cast("long")
    again = docs.join(ids.where("again"), doc_id.eqNullSafe(F.col("_id")), "left_semi")
    packed = again.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    row = packed.schema["row"].dataType
    named = packed.mapInArrow(name, f"row {row.simpleString()}, id long, sid long")
    hashed = [F.col("row")[f.name] for f in row if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    wordless = named.where("sid is null").select("row")
    chosen = named.join(best, "sid").where(F.col("id").eqNullSafe(F.col("least")))
    chosen = chosen.groupBy("sid").agg(F.min_by("row", F.xxhash64(*hashed)).alias("row")).select("row")
    return once.where("doc_id is not null").unionByName(wordless.union(chosen).select("row.*"))
