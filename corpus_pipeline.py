"""A training corpus from documents: quality rules, near duplicates, repeated passages, the mix, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes what a stage returns as
Parquet in the shared folder and reads it as the next one's docs. All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.llm import bpe, jaccard_join, mixing, quality_rules, substring_dedup
from pagequarry.llm.common import materialise

#: Near duplicates: shingles of five words, a similarity of 0.8 or more. Repeated passages: windows of 50 words.
SHINGLE, PERCENT, WINDOW = 5, 80, 50


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects."""
    return quality_rules.quality_filter(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of likes, that with the smallest doc_id."""
    return jaccard_join.keep_one(docs, SHINGLE, PERCENT)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that a document of smaller doc_id holds; texts that had nothing else go."""
    return substring_dedup.dedup_documents(docs, WINDOW)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix in training order, a row for each time that one is taken."""
    return mixing.mix_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the ids, and digests of the ids and of what they decode to."""
    encoded = bpe.encode_documents(docs, decoded="decoded")
    return encoded.select("doc_id", (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"), "token_ids", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("mixing sources to target weights", mix),
    ("byte-level BPE encoding and decoding", tokens),
]

#: Components, extension and BPE are beyond SQL: tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{i + 1}")
    return docs
