"""From raw documents to token ids: quality, near duplicates, personal data, mixing, encoding.

Defined cases, in every stage: null texts count as empty ones and stay null where a text is kept;
rows without an id are documents like others; of rows that repeat id and text, or that share an
id, the second stage keeps one; empty tables give empty tables; columns beyond those of documents
are kept, whatever they are called. n_chars is null only before a stage that sets it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm import minhash, mixing, pii, quality
from lexiloom.llm.common import stage, table
from lexiloom.llm.queries import token_digests


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, by shingles of five words."""
    return minhash.drop_near(docs, n=5)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data masked; n_chars follows the new text."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; the one at a source's cut with its first words, and n_chars follows."""
    return mixing.repeat(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digest of each document's token ids, and the digest of what they decode to."""
    return token_digests(docs)


STAGES = [("quality", good_quality), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mix", mix_sources), ("byte_bpe", byte_bpe)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
