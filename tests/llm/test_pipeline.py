"""The pipeline's stages, each against its operator and brute force."""

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    from tests.llm.test_ngrams import brute
    from tests.llm.test_tokens import by_library

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "toxicity", "ngram_jaccard_join", "best_fit_packing"]
    at, kept = docs, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, at, SF).cache()
        assert out.columns == docs.columns
        kept.append(([tuple(r) for r in at.select("doc_id", "text").collect()], {r.doc_id for r in out.collect()}))
        at = out
    rows, good = kept[0]
    known = [i for i, _ in rows if i in labels]
    assert np.mean([(i in good) == (labels[i].quality == 1) for i in known]) > 0.95
    rows, clean = kept[1]
    assert clean <= good and len(clean) > 0.8 * len(good)
    rows, one = kept[2]
    assert one == {doc for doc, _, least in brute(rows) if doc == least}
    packed = corpus_pipeline.run(spark, SF).collect()
    want = {r.doc_id: len(by_library(r.text)) + 1 for r in at.collect()}
    got = {}
    for r in packed:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == want
    assert len({r.sequence_id for r in packed}) <= sum(want.values()) / 2048 * 1.05 + 1
