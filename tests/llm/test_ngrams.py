"""The n-gram join against brute force."""

import random

import numpy as np
import pytest

from tidemark.llm.ngrams import Tree, candidate_pairs, keep_one, ngram_classes, shingle_sets, signature


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None and sets[i]:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted(((doc, len(sets[i]), least.get(find(i)) if sets[i] else doc) for i, (doc, _) in enumerate(rows)), key=repr)


def corpus(seed, n=150):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + str(rng.randrange(300))
    passage = [word() for _ in range(60)]
    texts = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.5 and texts:
            w = rng.choice(texts).split()
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                at = rng.randrange(len(w) + 1)
                w[at : at + rng.randrange(3)] = [word() for _ in range(rng.randrange(3))]
            texts.append(" ".join(w))
        else:
            w = [word() for _ in range(rng.choice([0, 1, 3, 5, 6, 9, 30, 80, 200]))]
            if rng.random() < 0.3:
                w[len(w) // 2 : len(w) // 2] = passage
            texts.append(" ".join(w))
    return [(i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize(("seed", "options"), [(1, {}), (2, {"frequent": 0}), (3, {"block": 4}), (4, {"frequent": 50, "block": 2}), (5, {"held": 2}), (6, {"frequent": 0, "held": 5, "block": 3})])
def test_classes_are_exact(spark, seed, options):
    rows = corpus(seed)
    got = ngram_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), **options)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows)


def test_a_family_of_many_parts(spark):
    """Edited copies of one text, far more than a part holds, and their links to the lead."""
    rng, words = random.Random(9), [f"w{i}" for i in range(60)]
    rows = [(0, " ".join(words))]
    for i in range(1, 700):
        w = list(words)
        w[rng.randrange(60)] = f"e{i}"
        rows.append((i, " ".join(w)))
    got = ngram_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(6))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows)


def test_odd_documents(odd_docs, no_docs):
    from tests.llm.conftest import ODD_TEXTS

    got = ngram_classes(odd_docs)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(ODD_TEXTS)
    kept = keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 3, 4, 5, 6, 8, 9, 10]
    assert ngram_classes(no_docs).count() == 0 and keep_one(no_docs).count() == 0


def test_one_row_of_each_class_stays(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(30)) for x in "abcd")
    rows = [(1, a, 0), (5, a + " more", 1), (5, b, 2), (7, c, 3), (7, c, 4), (7, c.upper(), 5), (None, a, 6), (None, d, 7), (None, d, 7), (9, "", 8), (9, "", 8), (None, None, 9), (8, b, 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sid int")
    for bound in (1 << 20, 0):
        kept = [tuple(r) for r in keep_one(docs.repartition(3), bound).collect()]
        seven = [r for r in kept if r[0] == 7]
        assert len(seven) == 1 and seven[0] in rows
        assert sorted((r for r in kept if r[0] != 7), key=repr) == sorted([(1, a, 0), (5, b, 2), (None, d, 7), (9, "", 8), (9, "", 8), (None, None, 9)], key=repr)
    assert keep_one(docs).schema == docs.schema


def test_a_link_at_the_threshold(spark):
    w = [f"x{i}" for i in range(104)]
    # 100 shingles each; a changed end leaves 89 or 88 in common of 111 or 112.
    at, below = [*w[:93], *[f"y{i}" for i in range(11)]], [*w[:92], *[f"y{i}" for i in range(12)]]
    for other, linked in ((at, 100 * 89 >= 80 * 111), (below, 100 * 88 >= 80 * 112)):
        rows = [(1, " ".join(w)), (2, " ".join(other))]
        got = {r.doc_id: r.component_id for r in ngram_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert (got[2] == 1) == linked


def test_trees_drop_no_possible_pair():
    rng = np.random.default_rng(0)
    for size in (1, 2, 9, 70):
        sets = []
        for _ in range(size):
            s = rng.integers(0, 1 << 62, rng.integers(1, 400), dtype=np.uint64)
            sets.append(np.unique(s))
            if rng.random() < 0.6:
                sets.append(np.unique(np.concatenate([s[: max(1, int(len(s) * rng.uniform(0.7, 1)))], rng.integers(0, 1 << 62, 3, dtype=np.uint64)])))
        n, sigs, ids = np.array(list(map(len, sets))), list(map(signature, sets)), np.arange(len(sets))
        a, b = candidate_pairs(ids, n, sigs, np.arange(len(sets)))
        found = set(zip(a.tolist(), b.tolist()))
        for i in range(len(sets)):
            for j in range(i + 1, len(sets)):
                common = len(np.intersect1d(sets[i], sets[j]))
                if 100 * common >= 80 * (n[i] + n[j] - common):
                    assert (i, j) in found
        assert candidate_pairs(ids, n, sigs, np.zeros(len(sets), int))[0].size == 0
        side = rng.integers(0, 2, len(sets))
        a, b = candidate_pairs(ids, n, sigs, np.arange(len(sets)), side)
        assert set(zip(a.tolist(), b.tolist())) == {(i, j) for i, j in found if side[i] != side[j]}
    assert len(Tree(ids, n, np.stack([np.zeros(1, np.uint64)] * len(n)), ids).levels) > 1


def test_shingles_split_as_bytes_do():
    texts = ["a b c d e f", "A\x0bB\x0cC\rD\nE F", "\x1ca b c d e f g", "", "  ", "é É é É é É"]
    for t, s in zip(texts, shingle_sets(texts)):
        assert len(s) == len(shingles(t))
    one, two = shingle_sets(texts)[:2]
    assert (one == two).all()
