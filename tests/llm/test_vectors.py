"""Near-duplicate vectors and nearest neighbours against brute force."""

import math

import numpy as np
import pytest

from tidemark.llm.near_vectors import CELL, WINDOW, calibrate, cell_chance, near_vectors
from tidemark.llm.nearest import nearest

SCHEMA = "vec_id long, embedding array<float>, label int, score double, rank int"


def table(spark, ids, x, extra=()):
    rows = [(int(i), [float(c) for c in v], 0, 0.1, 3) for i, v in zip(ids, x)]
    return spark.createDataFrame([*rows, *extra], SCHEMA)


def families(seed, n, width, noise, size):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width))
    x /= np.linalg.norm(x, axis=1)[:, None]
    for f in range(n // (2 * size)):
        x[f * size : (f + 1) * size] = x[f * size] + rng.normal(size=(size, width)) * noise
    x[n - 5 :] = x[n - 5]
    return x.astype(np.float32).astype(float) * rng.uniform(0.5, 2, n)[:, None]


ODD = [(90_001, None, 0, 0.0, 0), (90_002, [], 0, 0.0, 0), (90_003, [0.0] * 16, 0, 0.0, 0), (90_004, [float("nan")] + [1.0] * 15, 0, 0.0, 0), (90_005, [float("inf")] + [1.0] * 15, 0, 0.0, 0), (90_006, [None] + [1.0] * 15, 0, 0.0, 0), (90_007, [1.0] * 3, 0, 0.0, 0)]


@pytest.mark.parametrize(("seed", "noise", "size"), [(1, 0.02, 12), (2, 0.045, 30), (3, 0.06, 60)])
def test_links_and_classes(spark, seed, noise, size):
    x = families(seed, 700, 16, noise, size)
    x = np.float32(x).astype(float)
    rng = np.random.default_rng(seed)
    ids = rng.permutation(5000)[:700]
    u = x / np.linalg.norm(x, axis=1)[:, None]
    cos = u @ u.T
    link = cos >= 0.95
    np.fill_diagonal(link, False)
    sure = np.abs(cos - 0.95) > 1e-9
    assert sure.all()
    rows = near_vectors(table(spark, ids, x, ODD)).collect()
    got = {r.vec_id: r for r in rows}
    assert len(rows) == 707
    n = np.array([got[i].n_links for i in ids])
    want = link.sum(axis=1)
    assert (n <= want).all() and n.sum() >= 0.99 * want.sum()
    least = ids.copy()
    for _ in range(700):
        new = np.minimum(least, np.where(link, least[None, :], 1 << 40).min(axis=1))
        if (new == least).all():
            break
        least = new
    assert [got[i].component_id for i in ids] == least.tolist()
    for i in ids:
        assert got[i].kept == (got[i].component_id == i)
    for row in ODD:
        assert (got[row[0]].n_links, got[row[0]].component_id, got[row[0]].kept) == (0, row[0], True)


def test_equal_vectors_and_empty_tables(spark):
    t = spark.createDataFrame([(i, [1.0, 2.0], 0, 0.0, 0) for i in (5, 3, 9)] + [(4, [2.0, -1.0], 0, 0.0, 0), (None, [1.0, 2.0], 0, 0.0, 0)], SCHEMA)
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in near_vectors(t).collect()), key=repr)
    assert got == [(3, 2, 3, True), (4, 0, 4, True), (5, 2, 3, False), (9, 2, 3, False), (None, 0, None, True)]
    for empty in (t.limit(0), t.where("vec_id is null")):
        assert near_vectors(empty).count() == empty.count()
        assert nearest(empty).count() == 0


def test_nearest_has_recall_and_exact_scores(spark):
    rng = np.random.default_rng(4)
    x = np.float32(rng.normal(size=(3000, 16))).astype(float)
    x[100:140] = x[100]
    ids = np.arange(3000)
    got = {}
    for r in nearest(table(spark, ids, x, ODD), sample=500).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    assert set(got) == set(range(0, 3000, 100))
    hit = 0
    for q, rows in got.items():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, 11)) and rows == sorted(rows, key=lambda r: (r[1], r[2]))
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        assert all(abs(s - d[v]) < 1e-12 for _, s, v in rows)
        hit += len({v for *_, v in rows} & set(np.lexsort((ids, d))[:10].tolist()))
    assert hit >= 0.9 * 10 * len(got)
    assert [v for *_, v in got[100]] == list(range(101, 111)), "ties go to smaller ids"


def test_fewer_candidates_than_asked(spark):
    t = table(spark, [0, 100, 7], np.eye(3))
    got = sorted((r.query_id, r.rank, r.vec_id) for r in nearest(t).collect())
    assert got == [(0, 1, 7), (0, 2, 100), (100, 1, 0), (100, 2, 7)]


def test_more_copies_than_asked_in_the_sample(spark):
    rng = np.random.default_rng(6)
    for width, scale in ((64, 1.0), (64, 1e4), (64, 1e-5), (7, 1.0)):
        x = np.float32(rng.normal(size=(900, width)) * scale).astype(float)
        for f in range(0, 900, 100):
            x[f : f + 30] = x[f]
        got = {}
        for r in nearest(table(spark, np.arange(900), x)).collect():
            got.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
        assert {q: sorted(rows) for q, rows in got.items()} == {q: [(n, 0.0, q + n) for n in range(1, 11)] for q in range(0, 900, 100)}


@pytest.mark.parametrize("target", [0, 40])
def test_repeated_rows_are_one(spark, target):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 16)).round(3)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [rows[0]] * 11 + [rows[100]] + [rows[7]] * 30 + [(200, (x[200] + 5).tolist())]
    got = nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5), k=5, recall=1.0, confidence=50.0, target=target).collect()
    one = dict(reversed([(i, v) for i, v in rows if i != 200]))
    one[200] = min((v for i, v in rows if i == 200), key=lambda v: np.array(v, "<f8").tobytes())
    for q in (0, 100, 200, 300):
        want = sorted((float(np.sqrt(((np.array(one[q]) - np.array(v)) ** 2).sum())), i) for i, v in one.items() if i != q)[:5]
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [(r, i) for r, i, _ in mine] == [(n + 1, i) for n, (_, i) in enumerate(want)]
        assert np.allclose([s for *_, s in mine], [d for d, _ in want], rtol=1e-12)


@pytest.mark.parametrize("n", [2000, 8000])
def test_recall_at_two_sizes(spark, n):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(40, 24))[rng.integers(0, 40, n)] + 0.4 * rng.normal(size=(n, 24))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    got = {}
    for r in nearest(df, every=50, target=60).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in range(0, n, 50):
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hits += len(got[q] & set(np.argsort(d)[:10].tolist()))
    assert hits >= 0.9 * 10 * len(range(0, n, 50))


def test_a_loose_family(spark):
    """Vectors of cosine about 0.96 to each other, and as many strangers: no pair list, all links."""
    rng = np.random.default_rng(6)
    c = rng.normal(size=48)
    x = c / np.linalg.norm(c) + rng.normal(size=(1500, 48)) * 0.2 / np.sqrt(48)
    x = np.concatenate([x, rng.normal(size=(1500, 48))])
    u = x / np.linalg.norm(x, axis=1)[:, None]
    link = u @ u.T >= 0.95
    np.fill_diagonal(link, False)
    assert 0.3 < link[:1500, :1500].mean() < 0.999
    got = {r.vec_id: r for r in near_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)).collect()}
    n, want = np.array([got[i].n_links for i in range(3000)]), link.sum(1)
    assert (n <= want).all() and n.sum() >= 0.99 * want.sum()
    assert all(got[i].component_id == (0 if want[i] and i < 1500 else i) for i in range(3000))


def test_the_count_is_calibrated():
    for total in (100, 10**5, 10**9):
        cells, lists, count, near = calibrate(total, 0.95, 0.995)
        p = cell_chance(near, CELL * near) ** cells * math.erf(WINDOW / math.sqrt(2))
        at_least = lambda c: sum(math.comb(lists, k) * p**k * (1 - p) ** (lists - k) for k in range(c, lists + 1))
        assert count >= 3 and at_least(count) >= 0.995 > at_least(count + 1)
