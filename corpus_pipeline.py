"""A corpus pipeline: quality rules, quality classifier, near duplicates, packing.

Each stage takes (session, documents, folder of the tables) and returns a
DataFrame; it is stored as Parquet and read again as the next one's documents.

Defined cases: a null or empty text fails the first stage; rows without an id
are judged by their text in the first two stages, pass the third and are
packed; rows that share an id are one document for the third stage, and stay or
go together; extra columns are carried along; an empty table gives no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import common, jaccard, kneser_ney, packing, rules


#: Chunks that packing's encoder keeps, and bytes of text that it takes at once: the executors still hold memory of the stages before.
PACKING_CHUNKS, PACKING_BLOCK = 60_000, 1_000_000


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of the cascade rejects."""
    return rules.keep(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is at most the threshold of their language; trusted ones teach the model."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return kneser_ney.keep(docs, kneser_ney.trusted_labels(labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose sets of five-word shingles agree to 80 percent."""
    return jaccard.one_of_each(docs, n=5, num=80, den=100)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents in windows of 4096 tokens, with their token ids."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2, capacity=4096, with_ids=True, chunks=PACKING_CHUNKS, block=PACKING_BLOCK)


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("packing", pack_windows),
]

#: Perplexities and tokens are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
