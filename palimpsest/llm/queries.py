"""Registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import bpe, chat, gif, jaccard, kneser_ney, langid, packing, rules, sharding, sql, tokens

WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.tiktoken")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written as ranked variable-length files and read back."""
    return tokens.token_files(table(spark, sf_dir, "documents"), WORD_TOKENIZER, end_id=1, with_ids=False)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE of all documents, encoded and decoded."""
    return bpe.bpe_round_trip(table(spark, sf_dir, "documents"), BYTE_TOKENIZER)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into windows of 4096 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), WORD_TOKENIZER, end_id=2, capacity=4096)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of all documents under a model of the trusted ones, and whether they are kept."""
    trusted = kneser_ney.trusted_labels(table(spark, sf_dir, "labels"))
    return kneser_ney.classify(table(spark, sf_dir, "documents"), trusted)


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one that is full of marks, formatted and read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marks = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(marks).alias("text"))
    return chat.digest(chat.format_conversations(rows.unionByName(extra)))


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose sets of 3-word shingles agree to 90 percent."""
    return jaccard.similar_groups(table(spark, sf_dir, "documents"), n=3, num=90, den=100)


def op7_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features and verdict of the rule cascade on all documents."""
    return rules.judge(table(spark, sf_dir, "documents"), features=True)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of nearly equal size."""
    return sharding.shard_by_bytes(table(spark, sf_dir, "documents"), shards=40)


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents, learned from those that are not held out."""
    return langid.learn_and_identify(table(spark, sf_dir, "documents"))


def op10_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents stored as GIF files, read back and described."""
    return gif.media(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_files, op2_byte_bpe, op3_packing, op4_quality, op5_chat, op6_jaccard, op7_rules, op8_sharding, op9_langid, op10_gif)}


def oracle_sql() -> dict[str, str]:
    return {"op5_chat": sql.OP5, "op6_jaccard": sql.OP6, "op7_rules": sql.OP7}
