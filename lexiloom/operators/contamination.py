"""Overlap of a corpus with benchmark items by word shingles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.text import shingles


def text_fields(kind: str) -> list[Column]:
    """The fields of a benchmark's examples that are looked for."""
    one = {"translation": ["source_text", "reference_text"], "acceptability": ["sentence"], "qa": ["context", "question"]}
    if kind == "choice":
        return [F.concat(F.array("context"), F.col("choices"))]
    return [F.array(*one[kind])]


def benchmark_shingles(items: DataFrame, item_id: str, fields: list[str], n: int = 13) -> DataFrame:
    """Rows (shingle, item_id), each once."""
    texts = items.select(F.col(item_id).alias("item_id"), F.explode(F.array(*fields)).alias("t")).filter("t is not null")
    return texts.select("item_id", F.explode(shingles(F.col("t"), n)).alias("shingle")).distinct()


def hits(corpus: DataFrame, bench: DataFrame, doc_id: str, text: str = "text", n: int = 13) -> DataFrame:
    """Rows (doc_id, item_id, shingle) of shingles that both have.

    The join's small side is left to the size check of the planner, so a large benchmark is shuffled.
    """
    rows = corpus.filter(F.length(text) > 0).select(F.col(doc_id).alias("doc_id"), F.explode(shingles(F.col(text), n)).alias("shingle"))
    return rows.join(bench, "shingle").select("doc_id", "item_id", "shingle")


def per_item(found: DataFrame) -> DataFrame:
    return found.groupBy("item_id").agg(F.countDistinct("shingle").alias("n_shingles"), F.countDistinct("doc_id").alias("n_docs"), F.min("shingle").alias("first_shingle"))


def matched(found: DataFrame) -> DataFrame:
    """The sorted distinct shingles that each item shares with the corpus; a list is bounded by the item's own shingles."""
    return found.groupBy("item_id").agg(F.array_sort(F.collect_set("shingle")).alias("shingles"))


def summary(items: DataFrame, found: DataFrame, corpus: DataFrame, text: str = "text") -> DataFrame:
    """One row: items, contaminated items, their rate, documents scanned (those with text)."""
    n = items.agg(F.count(F.lit(1)).alias("n_items"))
    bad = found.agg(F.countDistinct("item_id").alias("n_contaminated"))
    docs = corpus.filter(F.length(text) > 0).agg(F.count(F.lit(1)).alias("docs_scanned"))
    rate = F.when(F.col("n_items") > 0, F.col("n_contaminated") / F.col("n_items")).otherwise(0.0)
    return n.crossJoin(bad).crossJoin(docs).withColumn("rate", rate)
