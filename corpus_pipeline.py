"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it
kept. ``run`` writes each stage's rows to the shared folder and reads them
again, so that a lost executor costs at most the stage at hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tackline.llm import durable, mixing, packing, quality, queries, secrets, simhash


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.7 or more."""
    return quality.keep_good(docs, queries.quality_model(spark, docs, sf_dir), 0.7)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts whose 5-word shingles have Jaccard similarity 0.8 or more the document with the smallest id."""
    return simhash.keep_one(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with secrets replaced."""
    return secrets.redact(docs)


def to_target_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose token shares by source, language and topic are the targets."""
    return mixing.sample(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 ids, with their ids."""
    return packing.pack(docs, queries.tokenizer_path(), cache=PACKING_CACHE)


#: Words whose ids a worker keeps: fewer than packing would by itself, as the earlier stages' memory is there too.
PACKING_CACHE = 200_000

STAGES = [
    ("quality_classifier", good_quality),
    ("simhash_near_dedup", one_of_each_group),
    ("secret_scan", without_secrets),
    ("target_mixture", to_target_mixture),
    ("packing", packed),
]

#: Learnt weights, 64-bit hashes and a tokenizer are beyond SQL; the tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = durable.written(stage(spark, docs, sf_dir))
    return docs
