"""Quality scores: random Fourier features over document statistics, ridge, isotonic calibration.

Statistics of a text (lengths, character classes, repetition, entropy, compressibility) are
standardised; cosines of random directions approximate a Gaussian kernel over them; each
partition sums its part of the normal equations; ridge regression on their sum gives raw
scores, and an isotonic curve, fitted on scores of folds left out, turns them into chances.

Labels are learned from at most `sample` labelled rows, those of smallest hash; the driver
receives sums and a histogram of `BINS` raw scores. Every document is scored, over its whole text.

Null texts are empty; repeated documents are scored alike; labels that are null or belong to
no document are left out; a document with several labels counts with each. Without labels of
both kinds every score is the share of label 1 (0.5 without any).
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bound_batches, cut, forget, fresh_worker, text_slices, texts_of

BINS = 512
#: Bytes compressed apart from the rest; their compressibility is the mean over a text.
WINDOW = 1000
_SENTENCE = re.compile(r"[.!?]+(?:\s|$)")
STATISTICS = (
    "log_bytes log_words mean_word long_words upper lower digits spaces punctuation symbols beyond_ascii bangs bars "
    "distinct_words top_word repeated_next log_lines line_length distinct_lines sentence_words capital_words mixed_words "
    "entropy compressed compressed_windows"
).split()

_CLASS = np.zeros(256, np.uint8)
for _chars, _k in ((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), (b"abcdefghijklmnopqrstuvwxyz", 2), (b"0123456789", 3), (b" \t\n\r\x0b\x0c", 4), (b".,;:'\"()-", 5), (b"#$%&*+/<=>@[\\]^_`{}~", 6), (b"!?", 7), (b"|", 8)):
    _CLASS[list(_chars)] = _k
_CLASS[128:] = 9


def statistics(text: str) -> list[float]:
    """The numbers a score rests on, all finite, also for the empty text."""
    raw = text.encode()
    n = max(1, len(raw))
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = np.bincount(_CLASS, counts, 10) / n
    words = text.split()
    m = max(1, len(words))
    often = Counter(words)
    again = sum(map(str.__eq__, words, words[1:]))
    lines = [x for x in text.split("\n") if x.strip()]
    p = counts[counts > 0] / n
    sentences = len(_SENTENCE.findall(text)) + 1
    capital = sum(map(str.isupper, words))
    plain = sum(map(str.isalpha, words))
    return [
        math.log1p(len(raw)), math.log1p(len(words)), min(40.0, len(text) / m), sum(c for w, c in often.items() if len(w) > 15) / m,
        share[1], share[2], share[3], share[4], share[5], share[6], share[9], share[7], share[8],
        len(often) / math.sqrt(m), max(often.values(), default=0) / m, again / m,
        math.log1p(len(lines)), math.log1p(len(text) / max(1, len(lines))), len(set(lines)) / max(1, len(lines)), math.log1p(m / sentences),
        capital / m, plain / m,
        float(-(p * np.log2(p)).sum()) if len(p) else 0.0, len(zlib.compress(raw, 1)) / n, sum(len(zlib.compress(raw[at : at + WINDOW], 1)) for at in range(0, n, WINDOW)) / n,
    ]


class Features:
    """Standardised statistics and cosines of random directions, from a seed."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, size: int, width: float, seed: int):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.directions = rng.normal(0, 1 / width, (len(mean), size))
        self.phases = rng.uniform(0, 2 * np.pi, size)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([np.sqrt(2 / len(self.phases)) * np.cos(z @ self.directions + self.phases), z / len(self.mean), np.ones((len(x), 1))])


class Model:
    """A raw score by ridge weights, and its chance by a monotone curve."""

    def __init__(self, features: Features | None, weights: np.ndarray, at: np.ndarray, chance: np.ndarray):
        self.features, self.weights, self.at, self.chance = features, weights, at, chance

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.features is None:
            return np.full(len(x), self.chance[0])
        return np.clip(np.interp(self.features(x) @ self.weights, self.at, self.chance), 0, 1)


def isotonic(at: np.ndarray, weight: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Non-decreasing means of total / weight by pooling adjacent violators; at is sorted."""
    blocks: list[list[float]] = []
    for w, t in zip(weight, total):
        blocks.append([w, t, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            w2, t2, k2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + w2, blocks[-1][1] + t2, blocks[-1][2] + k2]
    return np.concatenate([np.full(k, t / w) for w, t, k in blocks])


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """Whether a document's label is kept from learning."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1


def _map(rows: DataFrame, keep: list[str], column: str, kind: str, of) -> DataFrame:
    """keep and a column made of the last column's texts."""

    def run(batches):
        fresh_worker()
        for batch in batches:
            yield from (pa.RecordBatch.from_arrays([*(c.slice(at, len(texts)) for c in batch.columns[: len(keep)]), of(texts)], [*keep, column]) for at, texts in text_slices(batch.column(len(keep))))

    types = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join([*(f"{k} {types[k]}" for k in keep), f"{column} {kind}"]))


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(STATISTICS)) if len(column) else np.zeros((0, len(STATISTICS)))


def _statistics_column(texts):
    return pa.array([statistics(t) for t in texts], pa.list_(pa.float64()))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, sample: int) -> DataFrame:
    """doc_id, y and text of at most `sample` labelled documents, by smallest hash."""
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("y")).where(F.col("y").isin(0.0, 1.0) & F.col("doc_id").isNotNull() & learn)
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(sample)
    # At most `sample` rows of two numbers.
    return texts_of(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "text")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", learn: Column | None = None, sample: int = 20_000, size: int = 256, width: float = 4.0, ridge: float = 1e-3, folds: int = 3, seed: int = 7) -> Model:
    """Learn from the labelled rows that `learn` admits (default: those not held out)."""
    rows = labelled_sample(docs, labels, label, ~held_out() if learn is None else learn, sample)
    rows, path = cut(_map(rows, ["doc_id", "y"], "x", "array<double>", _statistics_column), "quality-sample")
    n_x = len(STATISTICS)
    sums = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0.0)).alias("y"), *[F.avg(F.element_at("x", i + 1)).alias(f"m{i}") for i in range(n_x)], *[F.stddev_pop(F.element_at("x", i + 1)).alias(f"s{i}") for i in range(n_x)]).first()
    if not 0 < sums["y"] < sums["n"]:
        forget(docs.sparkSession, path)
        return Model(None, np.zeros(0), np.zeros(1), np.array([sums["y"] / sums["n"] if sums["n"] else 0.5]))
    scale = np.array([sums[f"s{i}"] for i in range(n_x)])
    features = Features(np.array([sums[f"m{i}"] for i in range(n_x)]), np.where(scale > 1e-9, scale, 1.0), size, width, seed)
    d = size + n_x + 1

    def equations(batches):
        a, b, seen = np.zeros((folds, d, d)), np.zeros((folds, d)), False
        for batch in batches:
            z, y = features(_matrix(batch.column(2))), batch.column(1).to_numpy()
            fold = batch.column(0).to_numpy() % folds
            seen = True
            for f in range(folds):
                a[f] += z[fold == f].T @ z[fold == f]
                b[f] += z[fold == f].T @ y[fold == f]
        if seen:
            for f in range(folds):
                yield pa.RecordBatch.from_arrays([pa.array([f] * d), pa.array(range(d)), pa.array(list(np.hstack([a[f], b[f][:, None]])), pa.list_(pa.float64()))], ["fold", "i", "row"])

    # The sample is bounded, so these sums are of few partitions; one row an equation goes on.
    parts = rows.coalesce(4).mapInArrow(equations, "fold long, i long, row array<double>")
    total = np.zeros((folds, d, d + 1))
    for r in parts.toLocalIterator():
        total[r["fold"], r["i"]] += np.array(r["row"])

    def solve(eq):
        n = max(1.0, eq[-1, d - 1])
        return np.linalg.solve(eq[:, :d] + ridge * n / d * np.eye(d), eq[:, d])

    left_out = np.stack([solve(total.sum(0) - total[f]) for f in range(folds)])
    weights = solve(total.sum(0))

    def raw(batches):
        edges = np.linspace(-1, 2, BINS + 1)[1:-1]
        counts = np.zeros((BINS, 2))
        for batch in batches:
            z, y = features(_matrix(batch.column(2))), batch.column(1).to_numpy()
            fold = batch.column(0).to_numpy() % folds
            bins = np.searchsorted(edges, (z * left_out[fold]).sum(1))
            np.add.at(counts, bins, np.stack([np.ones(len(y)), y], 1))
        yield pa.RecordBatch.from_arrays([pa.array(range(BINS)), pa.array(counts[:, 0]), pa.array(counts[:, 1])], ["bin", "n", "y"])

    histogram = rows.coalesce(4).mapInArrow(raw, "bin long, n double, y double").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("y").alias("y")).where("n > 0").orderBy("bin").collect()
    bins, n, y = (np.array([float(r[c]) for r in histogram]) for c in ("bin", "n", "y"))
    forget(docs.sparkSession, path)
    return Model(features, weights, -1 + (bins + 0.5) * 3 / BINS, isotonic(bins, n, y))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every document."""
    return _map(texts_of(docs), ["doc_id"], "score", "double", lambda texts: pa.array(model.score(np.array([statistics(t) for t in texts]).reshape(-1, len(STATISTICS)))))


def quality(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    scored = score(docs, fit(docs, labels, **options))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5, **options) -> DataFrame:
    """The rows of docs whose score is at least `least`, with all their columns."""
    model = fit(docs, labels, **options)

    def run(batches):
        fresh_worker()
        for batch in batches:
            for at, texts in text_slices(batch.column(batch.schema.names.index("text"))):
                got = model.score(np.array([statistics(t) for t in texts]).reshape(-1, len(STATISTICS)))
                yield batch.slice(at, len(texts)).filter(pa.array(got >= least))

    bound_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
