"""Quality and toxicity: held-out accuracy, parts against plain forms, odd tables."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import quality as quality_stage
from tidemark.llm import toxicity as toxicity_stage
from tidemark.llm.quality import Features, held_out, isotonic, keep_good, quality, statistics
from tidemark.llm.toxicity import BEGINNINGS, Chain, Rows, fit, keep_clean, logistic, normal, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_quality_on_documents_held_out(tables):
    docs, labels = tables
    got = quality(docs, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == docs.count()
    rows = got.join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 100 and np.mean([r.predicted == r.quality for r in rows]) >= 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got.limit(200).collect())


def test_held_out_labels_change_nothing(tables):
    docs, labels = tables
    flipped = labels.withColumn("quality", F.when(held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted(tuple(r) for r in quality(docs, x).collect()) for x in (labels, flipped))
    assert a == b


def test_isotonic_is_the_best_monotone_fit():
    rng = random.Random(1)
    for _ in range(50):
        n = rng.randrange(1, 12)
        w, y = np.array([rng.randint(1, 4) for _ in range(n)], float), np.array([rng.random() for _ in range(n)])
        fit = isotonic(np.arange(n), w, w * y)
        assert (np.diff(fit) >= -1e-12).all() and abs((w * fit).sum() - (w * y).sum()) < 1e-9
        # The min-max form of the same fit.
        mean = lambda a, b: (w[a : b + 1] * y[a : b + 1]).sum() / w[a : b + 1].sum()
        assert np.allclose(fit, [max(min(mean(a, b) for b in range(i, n)) for a in range(i + 1)) for i in range(n)])


def test_features_approximate_the_kernel():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 5))
    f = Features(np.zeros(5), np.ones(5), 20_000, 2.0, 3)
    z = f(x)[:, :20_000]
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    assert np.abs(z @ z.T - np.exp(-d / 8)).max() < 0.05


def test_statistics_are_finite():
    for text in ("", " ", "a", "\x00", "😀" * 5000, "A B!! " * 3):
        assert np.isfinite(statistics(text)).all()


def test_every_window_counts_in_compressibility():
    rng = random.Random(3)
    head = " ".join(f"word{i % 90}" for i in range(400))[:1000]
    junk = "".join(chr(rng.randrange(33, 127)) for _ in range(2500))
    for text in (head, head[:300], "", head + junk, head + "again " * 500, junk + head * 3):
        raw = text.encode()
        windows = [raw[at : at + 1000] for at in range(0, len(raw), 1000)] or [b""]
        assert abs(statistics(text)[-1] - sum(len(zlib.compress(w, 1)) for w in windows) / max(1, len(raw))) < 1e-12
    assert statistics(head + junk)[-1] > statistics(head)[-1] > statistics(head + "again " * 500)[-1]


def test_quality_of_odd_tables(odd_docs, no_docs, odd_labels):
    rows = quality(odd_docs, odd_labels).collect()
    assert len(rows) == 12 and all(0 <= r.score <= 1 for r in rows)
    assert [r.held_out for r in rows if r.doc_id is None] == [False]
    assert quality(no_docs, odd_labels).count() == 0
    assert {r.score for r in quality(odd_docs, odd_labels.limit(0)).collect()} == {0.5}
    assert {r.score for r in quality(odd_docs, odd_labels.where("quality = 1")).collect()} == {1.0}
    kept = keep_good(odd_docs, odd_labels, least=0.0)
    assert kept.schema == odd_docs.schema and kept.count() == 12


def test_toxic_documents_are_found(tables):
    docs, labels = tables
    got = toxicity(docs, labels).join(labels.withColumnRenamed("toxic", "label"), "doc_id").collect()
    hit = [r.toxic for r in got if r.label == 1]
    assert np.mean(hit) >= 0.75 and not np.mean([r.toxic for r in got if r.label == 0]) > 0.01


def test_planted_toxic_words_in_unseen_documents(spark):
    rng = random.Random(4)
    clean = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(2000)]
    bad = ["zzqword", "xxinsult", "yyslur"]
    docs, labels = [], []
    for i in range(1200):
        w = rng.choices(clean, k=80)
        toxic = i % 6 == 0
        if toxic:
            for _ in range(3):
                w[rng.randrange(80)] = rng.choice(bad) + rng.choice(["", "ing", "ed"])
        docs.append((i, " ".join(w)))
        if i < 800:
            labels.append((i, int(toxic)))
    got = toxicity(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    wrong = [r.doc_id for r in got.collect() if r.toxic != (r.doc_id % 6 == 0)]
    assert len(wrong) <= 6


def test_later_models_read_earlier_probabilities():
    rng = np.random.default_rng(0)
    x = rng.poisson(0.5, (600, 4)).astype(float)
    y = np.stack([x[:, 0] > 0, (x[:, 0] > 0) & (x[:, 1] > 0)], 1).astype(float)
    chain = Chain(Rows.of(x), y)
    assert [len(w) for w in chain.weights] == [5, 6] and chain.weights[1][4] > 0
    assert ((chain.predict(Rows.of(x)) > 0.5) == (y > 0.5)).mean() > 0.95
    w = logistic(Rows.of(np.hstack([x, np.ones((600, 1))])), y[:, 0])
    assert w[0] > 1 and abs(w[2]) < 0.5


def newton(x, y, ridge=1.0):
    w, shrink = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    shrink[-1] = 1e-6
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(shrink), x.T @ (y - p) - shrink * w)
    return w


def test_chain_is_that_of_dense_loops(spark):
    """Features, folds, chain and scores by a plain second implementation, over all documents."""
    rng, docs, labels = random.Random(7), [], []
    words = {"en": [f"the{i}" for i in range(60)], "de": [f"der{i}" for i in range(60)]}
    for i in range(500):
        lang = rng.choice(["en", "en", "de"])
        w = rng.choices(words[lang], k=rng.randrange(0, 40))
        toxic = i % 4 == 0
        if toxic:
            w += [rng.choice({"en": ["badword", "badwords"], "de": ["schlimm"]}[lang])] * rng.randrange(1, 3)
        docs.append((i, " ".join(w), lang))
        if i < 400:
            labels.append((i, int(toxic) if rng.random() < 0.95 else 1 - int(toxic)))
    frame, told = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity(frame, told).collect()}

    def features(text):
        out = {}
        for w in normal(text).split():
            for m in [f" {w} ", *(f" {w[:k]}" for k in BEGINNINGS if len(w) > k)]:
                out[m] = out.get(m, 0) + 1
        return out

    found, y = {i: features(t) for i, t, _ in docs}, dict(labels)
    n1 = sum(y.values())
    n0 = len(y) - n1
    kept = []
    for m in {m for f in found.values() for m in f}:
        a, b = (sum(m in found[i] for i in y if y[i] == v) for v in (1, 0))
        cells = [(a, (a + b) * n1), (b, (a + b) * n0), (n1 - a, (n1 + n0 - a - b) * n1), (n0 - b, (n1 + n0 - a - b) * n0)]
        if a * n0 > b * n1 and 2 * sum(s * np.log(s * (n1 + n0) / o) for s, o in cells if s) >= 15:
            kept.append(m)
    kept.sort()
    fitted = fit(frame, told)
    assert fitted.markers.markers == kept and fitted.categories == ["toxic:en", "toxic:de", "toxic"]
    # The automaton counts a beginning in words that are no longer too.
    x = np.log1p([[sum(f" {w} ".startswith(m) for w in normal(t).split()) for m in kept] for _, t, _ in docs])
    lang = {i: g for i, _, g in docs}
    ids = sorted(y)
    own, one = x[ids], np.ones((len(ids), 1))
    targets = [[y[i] * (lang[i] == "en") for i in ids], [y[i] * (lang[i] == "de") for i in ids], [y[i] for i in ids]]
    fold, earlier, scores = np.arange(len(ids)) % 3, np.zeros((len(ids), 0)), np.zeros((len(docs), 0))
    for t in map(np.array, targets):
        seen = np.hstack([own, earlier, one])
        w = newton(seen, t)
        scores = np.hstack([scores, 1 / (1 + np.exp(-np.clip(np.hstack([x, scores, np.ones((len(docs), 1))]) @ w, -30, 30)))[:, None]])
        out = np.zeros(len(ids))
        for f in range(3):
            out[fold == f] = 1 / (1 + np.exp(-np.clip(seen[fold == f] @ newton(seen[fold != f], t[fold != f]), -30, 30)))
        earlier = np.hstack([earlier, out[:, None]])
    for i, _, _ in docs:
        assert np.allclose([got[i].categories[c] for c in fitted.categories], scores[i], atol=1e-6)
        assert got[i].score == got[i].categories["toxic"] and got[i].toxic == (got[i].score >= 0.5)


def test_toxicity_of_odd_tables(odd_docs, no_docs, odd_labels):
    assert toxicity(odd_docs, odd_labels).count() == 12
    assert toxicity(no_docs, odd_labels).count() == 0
    assert not any(r.toxic for r in toxicity(odd_docs, odd_labels.limit(0)).collect())
    kept = keep_clean(odd_docs, odd_labels.where("toxic = 0"))
    assert kept.schema == odd_docs.schema and kept.count() == 12


@pytest.mark.parametrize("stage", [quality_stage, toxicity_stage])
def test_stages_give_up_what_a_worker_holds_of_others(spark, monkeypatch, stage):
    """Encoders that packing left in Python workers are gone when another stage's rows come."""

    def load(batches):
        from tidemark.llm import tokens

        tokens.loaded["left"] = bytearray(10)
        yield from batches

    class Probe:
        def score(self, x):
            from tidemark.llm import tokens

            return np.full(len(x), 0.0 if tokens.loaded else 1.0)

    docs = spark.range(64).select(F.col("id").alias("doc_id"), F.lit("some words").alias("text")).repartition(32)
    docs.mapInArrow(load, docs.schema).count()
    monkeypatch.setattr(stage, "fit", lambda *a, **b: Probe())
    if stage is toxicity_stage:
        monkeypatch.setattr(stage, "_probabilities", lambda fitted, texts: 1.0 - fitted.score(texts)[:, None])
        assert stage.keep_clean(docs, None).count() == 64
    else:
        assert stage.keep_good(docs, None).count() == 64
