"""A training corpus from documents: quality, toxicity, near-duplicates, packing.

Each stage gets what its predecessor kept, written as Parquet and read again, and all but the
last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.ngrams import keep_one
from tidemark.llm.packing import pack
from tidemark.llm.quality import keep_good
from tidemark.llm.queries import BYTE_BPE, table
from tidemark.llm.shared import cut, forget
from tidemark.llm.toxicity import keep_clean


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, table(spark, sf_dir, "labels"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_clean(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, BYTE_BPE)


STAGES = [("quality_classifier", quality_classifier), ("toxicity", toxicity), ("ngram_jaccard_join", near_duplicates), ("best_fit_packing", packing)]

#: Learned models and byte-pair ids can't be written in SQL; tests hold the result against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, path = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before:
            forget(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
