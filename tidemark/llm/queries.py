"""One registered query for each operator of this package, over its whole table."""

from __future__ import annotations

import public_tokenizers

from .html_text import extract
from .licenses import license_scan, license_sql
from .ngrams import ngram_classes
from .near_vectors import near_vectors
from .nearest import nearest
from .packing import pack
from .pieces import piece_digest
from .quality import quality
from .token_files import token_file_digest
from .toxicity import toxicity

BYTE_BPE, PIECE_BPE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


QUERIES = {
    "op1_html_extraction": lambda spark, d: extract(table(spark, d, "pages")),
    "op2_token_files": lambda spark, d: token_file_digest(table(spark, d, "documents"), BYTE_BPE),
    "op3_embedding_near_dedup": lambda spark, d: near_vectors(table(spark, d, "embeddings")),
    "op4_quality": lambda spark, d: quality(table(spark, d, "documents"), table(spark, d, "labels")),
    "op5_license_scan": lambda spark, d: license_scan(table(spark, d, "documents"), wrapped=True),
    "op6_toxicity": lambda spark, d: toxicity(table(spark, d, "documents"), table(spark, d, "labels")),
    "op7_ngram_join": lambda spark, d: ngram_classes(table(spark, d, "documents")),
    "op8_nearest_neighbours": lambda spark, d: nearest(table(spark, d, "embeddings")),
    "op9_piece_codec": lambda spark, d: piece_digest(table(spark, d, "documents"), PIECE_BPE),
    "op10_best_fit_packing": lambda spark, d: pack(table(spark, d, "documents"), BYTE_BPE),
}

ORACLES = {"op5_license_scan": license_sql()}
