"""Connected components, both ways, against a loop."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import shared
from tidemark.llm.shared import SLICE, components, text_slices, texts_of


def smallest(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("bound", [0, 1 << 20])
@pytest.mark.parametrize("shape", ["random", "chain", "star", "none"])
def test_components(spark, shape, bound):
    rng = random.Random(7)
    edges = {
        "random": [(rng.randrange(-40, 90), rng.randrange(90)) for _ in range(60)] + [(5, 5), (200, 200)],
        "chain": [(i, i + 1) for i in rng.sample(range(40), 40)],
        "star": [(50, i) for i in range(100)] * 2,
        "none": [],
    }[shape]
    got = components(spark.createDataFrame(edges, "a long, b long"), "test", bound=bound)[0].collect()
    assert {r.node: r.component for r in got} == smallest(edges) and len(got) == len({r.node for r in got})


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_text_slices(monkeypatch, kind):
    monkeypatch.setattr(shared, "SLICE", 10)
    texts = [None, "", "abc", "日本語の長い文", "", "x" * 45, None, "de", "f" * 10, "g"]
    parts = list(text_slices(pa.array(["before", *texts], kind).slice(1)))
    assert [t for _, part in parts for t in part] == [t or "" for t in texts]
    assert [at for at, _ in parts] == [sum(len(p) for _, p in parts[:i]) for i in range(len(parts))]
    assert len(parts) > 3 and all(sum(len((t or "").encode()) for t in part[:-1]) < 10 for _, part in parts)
    assert list(text_slices(pa.array([], kind))) == [] and list(text_slices(pa.array([None], kind))) == [(0, [""])]


def test_batches_end_at_their_bytes(spark):
    """A batch of rows takes SLICE bytes and one text at most, however many rows."""

    def sizes(batches):
        yield from (pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "size"]) for b in batches)

    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.expr("repeat('a', 100000)").alias("text")).coalesce(1)
    rows = texts_of(docs).mapInArrow(sizes, "n long, size long").collect()
    assert sum(r.n for r in rows) == 400 and max(r.size for r in rows) <= SLICE + 200_000


@pytest.mark.parametrize("size", [1, 100, 1000, SLICE])
def test_slices_of_any_size_hold_every_text_once(size):
    texts = ["é" * (i % 37) if i % 5 else None for i in range(300)]
    got = list(text_slices(pa.array(texts), size))
    assert [t for _, part in got for t in part] == [t or "" for t in texts]
    assert [at for at, _ in got] == [sum(len(part) for _, part in got[:k]) for k in range(len(got))]
    assert all(sum(len(t.encode()) for t in part) <= size + 2 * 37 for _, part in got)
