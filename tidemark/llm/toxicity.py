"""Toxicity by a classifier chain over the whole vocabulary.

Categories are predicted in turn, each by logistic regression: toxic in the language most toxic
documents are in, in the next, and so on, and last toxic at all. What the language of a labelled document
is (its `lang`) only makes targets; a score reads text alone. Each model also reads the
probabilities of the earlier categories; while learning, those come from models of other folds, so
that later models see earlier probabilities as they will be on unseen documents.

Every word and every beginning of a longer word, of BEGINNINGS letters, is a feature that is tested:
those more frequent in toxic labelled documents, with a likelihood ratio statistic of `least` or more, are
kept, all of them, with a weight from the logarithm of their count; the others have weight 0.

Learning takes at most `positives` toxic and `negatives` clean labelled rows, those of smallest
hash. The driver holds that sample's counts of features kept, nothing of other documents. Every
document is scored, over its whole text.

Null texts are empty, and clean; repeated documents are scored alike; null labels and labels other than 0
and 1 are left out; a label stated twice counts twice. Without labels of both kinds nothing is toxic
and probabilities are 0. Documents without a `lang` column, or with too few toxic ones of any language,
make a chain of the last category alone. An empty table gives no rows; other columns, of any name, are ignored by
toxicity() and kept by keep_clean().
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bound_batches, cut, forget, fresh_worker, text_slices, texts_of

_BREAK = re.compile(r"[\W_]+")
BEGINNINGS = (4, 5, 6, 7)


def normal(text: str) -> str:
    """Lower-cased words, each between two spaces."""
    return f" {_BREAK.sub('  ', text.lower())} "


def _candidates(text: str) -> set[str]:
    """A text's words (between spaces) and beginnings of longer words (after a space)."""
    words = set(normal(text).split())
    return {f" {w} " for w in words} | {f" {w[:k]}" for w in words for k in BEGINNINGS if len(w) > k}


class Markers:
    """Counts of markers in a text, by one automaton."""

    def __init__(self, markers: list[str]):
        self.markers = markers
        self._automaton = None

    def __getstate__(self):
        return {"markers": self.markers, "_automaton": None}

    def counts(self, text: str) -> dict[int, int]:
        if not self.markers:
            return {}
        if self._automaton is None:
            import ahocorasick

            self._automaton = ahocorasick.Automaton()
            for i, m in enumerate(self.markers):
                self._automaton.add_word(m, i)
            self._automaton.make_automaton()
        return Counter(i for _, i in self._automaton.iter(normal(text)))


class Rows:
    """A sparse matrix by rows: what a linear model needs of one."""

    def __init__(self, row: np.ndarray, column: np.ndarray, value: np.ndarray, shape: tuple[int, int]):
        self.row, self.column, self.value, self.shape = row, column, value, shape

    @classmethod
    def of(cls, x: np.ndarray) -> Rows:
        row, column = np.nonzero(x)
        return cls(row, column, x[row, column], x.shape)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.column], self.shape[0])

    def down(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, self.value * v[self.row], self.shape[1])

    def only(self, keep: np.ndarray) -> Rows:
        at, own = np.cumsum(keep) - 1, keep[self.row]
        return Rows(at[self.row[own]], self.column[own], self.value[own], (int(keep.sum()), self.shape[1]))

    def beside(self, more: np.ndarray) -> Rows:
        """With further, dense columns."""
        n, k = more.shape
        return Rows(np.concatenate([self.row, np.repeat(np.arange(n), k)]), np.concatenate([self.column, np.tile(self.shape[1] + np.arange(k), n)]), np.concatenate([self.value, more.ravel()]), (n, self.shape[1] + k))


def logistic(x: Rows, y: np.ndarray, ridge: float = 1.0, steps: int = 25, inner: int = 200) -> np.ndarray:
    """Weights by Newton's method, each step solved by conjugate gradients; the last column of x is the constant, which is not shrunk."""
    w = np.zeros(x.shape[1])
    shrink = np.full(x.shape[1], ridge)
    shrink[-1] = 1e-6
    for _ in range(steps):
        p = chance(x.dot(w))
        weight = p * (1 - p) + 1e-6
        step, rest = np.zeros_like(w), x.down(y - p) - shrink * w
        way, size = rest.copy(), float(rest @ rest)
        for _ in range(inner):
            if size < 1e-18:
                break
            turned = x.down(weight * x.dot(way)) + shrink * way
            length = size / float(way @ turned)
            step += length * way
            rest -= length * turned
            size, old = float(rest @ rest), size
            way = rest + size / old * way
        w += step
        if np.abs(step).max() < 1e-7:
            break
    return w


def chance(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Chain:
    """Linear models of categories, in order, each reading the earlier ones' probabilities. x holds counts."""

    def __init__(self, x: Rows, y: np.ndarray, folds: int = 3, ridge: float = 1.0):
        n = x.shape[0]
        x = Rows(x.row, x.column, np.log1p(x.value), x.shape)
        fold, one = np.arange(n) % folds, np.ones((n, 1))
        earlier, self.weights = np.zeros((n, 0)), []
        for k in range(y.shape[1]):
            seen = x.beside(np.hstack([earlier, one]))
            self.weights.append(logistic(seen, y[:, k], ridge))
            out = np.zeros(n)
            if k + 1 < y.shape[1]:
                for f in range(folds):
                    out[fold == f] = chance(seen.only(fold == f).dot(logistic(seen.only(fold != f), y[fold != f, k], ridge)))
            earlier = np.hstack([earlier, out[:, None]])

    def predict(self, x: Rows) -> np.ndarray:
        n = x.shape[0]
        x, earlier = Rows(x.row, x.column, np.log1p(x.value), x.shape), np.zeros((n, 0))
        for w in self.weights:
            p = chance(x.dot(w[: x.shape[1]]) + earlier @ w[x.shape[1] : -1] + w[-1])
            earlier = np.hstack([earlier, p[:, None]])
        return earlier


class Fitted(NamedTuple):
    markers: Markers
    categories: list[str]
    chain: Chain | None


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", positives: int = 3_000, negatives: int = 6_000, least: float = 15.0, fewest: int = 20) -> Fitted:
    """Features and chain, from the labelled documents. A language with under `fewest` toxic ones of the sample is no category."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("y in (0, 1) and doc_id is not null")
    chosen = known.where("y = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(positives).union(known.where("y = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(negatives))
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), lang.alias("lang"))
    bound_batches(docs.sparkSession)
    # At most positives + negatives rows of two numbers.
    rows, path = cut(texts.join(F.broadcast(chosen), "doc_id"), "toxicity-sample")
    spark = docs.sparkSession
    totals = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    if len(totals) < 2:
        forget(spark, path)
        return Fitted(Markers([]), [label], None)

    def candidates(batches):
        fresh_worker()
        for batch in batches:
            for at, texts in text_slices(batch.column(0)):
                got: dict[str, list[int]] = defaultdict(lambda: [0, 0])
                for text, y in zip(texts, batch.column(1).slice(at, len(texts)).to_pylist()):
                    for c in _candidates(text):
                        got[c][y] += 1
                yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.string()), pa.array([v[1] for v in got.values()], pa.int64()), pa.array([v[0] for v in got.values()], pa.int64())], ["marker", "pos", "neg"])

    counted = rows.select("text", "y").mapInArrow(candidates, "marker string, pos long, neg long").groupBy("marker").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    best = counted.where(told_apart(F.col("pos"), F.col("neg"), totals[1], totals[0]) >= least).where(F.col("pos") * totals[0] > F.col("neg") * totals[1])
    markers = Markers(sorted(r["marker"] for r in best.select("marker").collect()))  # features of the bounded sample

    def count(batches):
        for batch in batches:
            found = [markers.counts(t) for _, texts in text_slices(batch.column(1)) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array([list(c) for c in found], pa.list_(pa.int32())), pa.array([list(c.values()) for c in found], pa.list_(pa.int32()))], ["doc_id", "y", "lang", "at", "n"])

    got = rows.select("doc_id", "text", "y", "lang").mapInArrow(count, "doc_id long, y int, lang string, at array<int>, n array<int>").orderBy("doc_id", "y").toPandas()  # the bounded sample
    forget(spark, path)
    y, langs = got["y"].to_numpy(float), got["lang"].fillna("").to_numpy(str)
    x = _matrix([dict(zip(a, n)) for a, n in zip(got["at"], got["n"])], len(markers.markers))
    held = Counter(langs[(y == 1) & (langs != "")].tolist())
    kept = [name for name, n in sorted(held.items(), key=lambda i: (-i[1], i[0])) if n >= fewest]
    targets = np.stack([*(y * (langs == name) for name in kept), y], 1)
    return Fitted(markers, [f"{label}:{name}" for name in kept] + [label], Chain(x, targets))


def told_apart(pos, neg, positives: int, negatives: int):
    """How much likelier (twice the logarithm) a feature's two frequencies are than one common one."""
    total = positives + negatives

    def part(seen, of):
        return F.when(seen > 0, seen * F.log(seen / of)).otherwise(0.0)

    both = pos + neg
    of = [both * positives / total, both * negatives / total, (total - both) * positives / total, (total - both) * negatives / total]
    return 2 * sum((part(s, o) for s, o in zip((pos, neg, positives - pos, negatives - neg), of)), F.lit(0.0))


def _matrix(found: list[dict[int, int]], width: int) -> Rows:
    """Counts of features, a dict a row, as a matrix."""
    sizes = [len(c) for c in found]
    column = np.fromiter((i for c in found for i in c), np.int64, sum(sizes))
    value = np.fromiter((n for c in found for n in c.values()), float, sum(sizes))
    return Rows(np.repeat(np.arange(len(found)), sizes), column, value, (len(found), width))


def _probabilities(fitted: Fitted, texts: list[str]) -> np.ndarray:
    if fitted.chain is None or not texts:
        return np.zeros((len(texts), len(fitted.categories)))
    return fitted.chain.predict(_matrix([fitted.markers.counts(t) for t in texts], len(fitted.markers.markers)))


def toxicity(docs: DataFrame, labels: DataFrame, least: float = 0.5, **options) -> DataFrame:
    """doc_id, toxic (whether the last probability is at least `least`), score, and the probability of every category."""
    fitted = fit(docs, labels, **options)

    def run(batches):
        for batch in batches:
            for at, texts in text_slices(batch.column(1)):
                p = _probabilities(fitted, texts)
                named = [list(zip(fitted.categories, row)) for row in p.tolist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(p[:, -1] >= least), pa.array(p[:, -1]), pa.array(named, pa.map_(pa.string(), pa.float64()))], ["doc_id", "toxic", "score", "categories"])

    return texts_of(docs).mapInArrow(run, "doc_id long, toxic boolean, score double, categories map<string,double>")


def keep_clean(docs: DataFrame, labels: DataFrame, least: float = 0.5, **options) -> DataFrame:
    """The rows of docs that are not toxic, with all their columns."""
    fitted = fit(docs, labels, **options)

    def run(batches):
        fresh_worker()
        for batch in batches:
            for at, texts in text_slices(batch.column(batch.schema.names.index("text"))):
                p = _probabilities(fitted, texts)
                yield batch.slice(at, len(texts)).filter(pa.array(p[:, -1] < least))

    bound_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
