"""A corpus pipeline of five stages, each written as Parquet and read again.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it
has kept. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from inkwell.llm import bpe, exact_dedup, mixing, near_dedup, quality
from inkwell.llm.common import checkpoint_dir, remove_folder


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of a good rating is under 0.3 go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_selected(docs, quality.learn(docs, labels))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays."""
    return exact_dedup.drop_exact_duplicates(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates (five words, similarity 0.8) the smallest id stays."""
    return near_dedup.drop_near_duplicates(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources mixed to their weights, a row for each part of a document in a slot, in
    the order of shards and slots."""
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row of the mixture, and the digest of what they decode to."""
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return bpe.encode_with_digests(docs, ranks, pattern, keep_ids=True, fixed=True)


STAGES = [
    ("quality classifier", select_quality),
    ("exact dedup", exact_duplicates),
    ("simhash near-dedup", near_duplicates),
    ("mixing sources", mixture),
    ("byte-level bpe", tokens),
]

#: SQL can express neither the classifier nor the fingerprints; tests/llm holds each
#: stage against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written below the checkpoint folder and read again,
    and removed when the next one is written."""
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            remove_folder(spark, f"{folder}/{k - 1}")
    return docs
