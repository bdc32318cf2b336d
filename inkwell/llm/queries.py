"""The ten operators as queries over whole tables, and SQL where it can say the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, fingerprints, language_id, mixing, near_dedup, quality, sharding, token_output, toxicity
from .common import checkpoint_dir, settle


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(id_col: str = "doc_id") -> Column:
    """CRC-32 of the id as text, by which rows are held out; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))


def op1_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard files are written below the checkpoint folder; the rows are read from them."""
    folder = f"{checkpoint_dir(spark)}/training-{uuid.uuid4().hex}"
    token_output.write_shards(table(spark, sf_dir, "documents"), folder, fixed=True)
    return token_output.read_shards(spark, folder)


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.learn(docs.where(fold() % 5 != 0))
    found = language_id.identify(docs, model)
    return found.select("doc_id", (fold() % 5 == 0).alias("held_out"), "lang_pred", "score")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also ``near_class``: the least fingerprint that one reaches by steps of three bits or fewer."""
    rows = settle(fingerprints.edit_likeness(table(spark, sf_dir, "documents")))
    found = fingerprints.with_near_class(rows, radius=3)
    return found.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "near_class")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.learn(docs, labels.where(fold() % 3 != 1))
    found = toxicity.score_toxicity(docs, model)
    return found.select("doc_id", (fold() % 3 == 1).alias("held_out"), "score", "predicted")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality.grade(docs, quality.learn(docs, labels))


def op6_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.assign_shards(table(spark, sf_dir, "documents"), shards=40)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(table(spark, sf_dir, "documents"), words=3, radius=2, radius2=-1)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mixture takes of every row; repeated rows are mixed each by itself."""
    rows, picks = mixing.mix(table(spark, sf_dir, "documents"))
    taken = picks.groupBy("row").agg(F.sum("words").alias("taken"))
    return rows.join(taken, "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return bpe.encode_with_digests(table(spark, sf_dir, "documents"), ranks, pattern, fixed=True)


def op10_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_training_order, op2_language, op3_simhash, op4_toxicity, op5_quality, op6_shards, op7_near_duplicates, op8_mixture, op9_byte_bpe, op10_exact_duplicates)
}

ORACLE_SQL: dict[str, str] = {
    "op10_exact_duplicates": """
        SELECT doc_id,
               max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
               count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents
    """,
}
