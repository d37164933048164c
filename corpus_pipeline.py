"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes every
stage's rows as Parquet in the shared folder and reads them again for the next. All
but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from telemill.llm import exact_dedup, mixing, packing, quality, queries, similar
from telemill.llm.common import written


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality posterior is at least one half; learned from ``labels``."""
    model = quality.learn(docs, queries.labels(spark, sf_dir))
    return quality.keep_good(docs, model, *queries.site_columns())


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id."""
    return exact_dedup.keep_first_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts whose five-word shingles are similar to 0.8 or more, the document with the smallest doc_id."""
    return similar.keep_one_each(docs, shingle=5, similarity=0.8)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: rows repeat by whole epochs, a last epoch is sampled by quality."""
    return mixing.mix(docs, quality=queries.by_quality(spark, docs, sf_dir))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens. Workers that are reused hold other stages' tables too, so they keep fewer pre-tokens."""
    return packing.pack(docs, queries.TOKENIZER, with_ids=False, cache_limit=100_000).drop("ids")


STAGES = [
    ("quality", keep_good),
    ("exact_dedup", drop_copies),
    ("simhash", drop_near_copies),
    ("mixing", mix),
    ("packing", pack),
]

#: SQL can express neither the classifier nor the tokenizer; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
