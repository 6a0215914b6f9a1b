"""Scores of predictions: accuracy, correlation, thresholds, answers, translation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions.text import normalized_answer
from lexiloom.llm.common import mapped
from lexiloom.operators.frames import prefix_sums


def best_choice(scores: DataFrame, example: str = "example", choice: str = "choice", value: str = "logprob") -> DataFrame:
    """The choice of the highest score of each example; the first of equals."""
    return scores.groupBy(example).agg(F.max(F.struct(F.col(value), -F.col(choice))).alias("m")).select(example, (-F.col("m.col2")).alias("predicted"))


def accuracy(df: DataFrame, right: Column, by: str) -> DataFrame:
    """Accuracy per ``by`` and, with a null there, over all."""
    return df.withColumn("__r", right.cast("double")).groupingSets([[F.col(by)], []], F.col(by)).agg(F.avg("__r").alias("accuracy"), F.count(F.lit(1)).alias("n"))


def confusion(df: DataFrame, label: Column, predicted: Column) -> DataFrame:
    one = lambda a, b: F.sum(F.when((label == a) & (predicted == b), 1).otherwise(0)).cast("double")
    return df.agg(one(1, 1).alias("tp"), one(0, 0).alias("tn"), one(0, 1).alias("fp"), one(1, 0).alias("fn"))


def matthews(tp: Column, tn: Column, fp: Column, fn: Column) -> Column:
    """Matthews correlation; 0 if a margin is empty."""
    under = (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)
    return F.when(under > 0, (tp * tn - fp * fn) / F.sqrt(under)).otherwise(0.0)


def mcc(df: DataFrame, label: str, predicted: str) -> DataFrame:
    c = F.col
    return confusion(df, c(label), c(predicted)).select(matthews(c("tp"), c("tn"), c("fp"), c("fn")).alias("mcc"))


def best_threshold(df: DataFrame, label: str, score: str) -> DataFrame:
    """The threshold (score >= threshold is positive) of the highest correlation; the lowest of equals.

    Only distinct scores are tried, from per-score counts, and one above all of them.
    """
    tally = df.groupBy(F.col(score).cast("double").alias("t")).agg(F.sum(F.col(label)).cast("double").alias("pos"), F.sum(1 - F.col(label)).cast("double").alias("neg"))
    summed = prefix_sums(tally, ["t"], {"__p": "pos", "__n": "neg"})
    totals = tally.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    rows = summed.crossJoin(F.broadcast(totals)).select("t", (F.col("__p") - F.col("pos")).alias("fn"), (F.col("__n") - F.col("neg")).alias("tn"), "p", "n")  # one row
    none = rows.groupBy().agg((F.max("t") + 1).alias("t"), F.max("p").alias("fn"), F.max("n").alias("tn"), F.max("p").alias("p"), F.max("n").alias("n")).filter("t is not null")
    rows = rows.unionByName(none)
    c = F.col
    value = F.round(matthews(c("p") - c("fn"), c("tn"), c("n") - c("tn"), c("fn")), 12)
    best = rows.withColumn("mcc", value).agg(F.max(F.struct("mcc", (-c("t")).alias("t"))).alias("b"))
    return best.select((-c("b.t")).alias("threshold"), c("b.mcc").alias("mcc"))


def first_samples(df: DataFrame, by: str, order: str, n: int) -> DataFrame:
    """The first n raw rows of each ``by``, shown beside aggregates over all rows."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(order))
    return df.withColumn("place", place).filter(F.col("place") <= n)


def token_f1(df: DataFrame, keys: list[str], prediction: str, reference: str) -> DataFrame:
    """Exact match and token F1 of normalised answers, the best over the references of each key."""
    p, r = normalized_answer(F.col(prediction)), normalized_answer(F.col(reference))
    bag = lambda x: F.filter(F.split(x, " "), lambda t: t != "")
    rows = df.select(*keys, p.alias("p"), r.alias("r")).withColumns({"a": bag(F.col("p")), "b": bag(F.col("r"))})
    kinds = F.array_distinct(F.col("a"))
    often = lambda xs, t: F.size(F.filter(xs, lambda x: x == t))
    common = F.aggregate(kinds, F.lit(0), lambda acc, t: acc + F.least(often(F.col("a"), t), often(F.col("b"), t)))
    rows = rows.withColumn("common", common)
    both = F.size("a") + F.size("b")
    f1 = F.when(both == 0, 1.0).otherwise(2.0 * F.col("common") / both)
    return rows.groupBy(*keys).agg(F.max((F.col("p") == F.col("r")).cast("double")).alias("exact"), F.max(f1).alias("f1"))


def clipped(tokens: np.ndarray, length: np.ndarray, n_rows: int, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For n from 1 to ``order``: clipped common n-grams of each row, and their totals by side and row.

    ``tokens`` are numbers from 0, those of all rows of one side and then those of the other;
    ``length`` has the rows' lengths in the same order. An n-gram is its first n - 1 tokens' number
    with the last token, and numbers are dealt anew before they outgrow 64 bits, so none coincide.
    """
    kinds = int(tokens.max(initial=0)) + 1
    row = np.repeat(np.arange(2 * n_rows), length)
    left = np.repeat(np.cumsum(length), length) - np.arange(len(tokens))  # tokens of the row from here on
    gram, size = tokens.astype(np.int64), kinds
    for n in range(1, order + 1):
        if n > 1:
            if size * kinds * n_rows >= 1 << 62:
                names, gram = np.unique(gram, return_inverse=True)
                size = len(names)
            keep = left[: len(gram)] >= n
            gram, size = np.where(keep, gram * kinds + np.append(tokens[n - 1 :], np.zeros(n - 1, np.int64))[: len(gram)], 0), size * kinds
        ok = left >= n
        keys, side = row[ok] % n_rows * size + gram[ok], row[ok] >= n_rows
        (x, cx), (y, cy) = np.unique(keys[~side], return_counts=True), np.unique(keys[side], return_counts=True)
        both, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
        yield np.bincount(both // size, np.minimum(cx[i], cy[j]), n_rows), np.maximum(length - n + 1, 0).reshape(2, n_rows)


def numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of lists of strings as numbers, or of strings as code points, and each row's length; null rows have none."""
    if pa.types.is_list(column.type):
        flat = column.flatten()
        return flat.dictionary_encode().indices.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    texts = column.fill_null("")
    points = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), np.uint32)
    names = np.unique(points)
    return np.searchsorted(names, points).astype(np.int64), pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)


def ngram_matches(df: DataFrame, key: str, a: Column, b: Column, order: int, overall: str | None = None) -> DataFrame:
    """Rows (key, n, matches, total_a, total_b) for n from 1 to ``order``: clipped common n-grams of two token arrays, or of the characters of two strings.

    Each pair of texts is counted where it is, so only sums are shuffled. ``overall`` names a key that stands for all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                m = batch.num_rows
                sides = pa.concat_arrays([batch.column("a"), batch.column("b")])
                coded = batch.column("key").dictionary_encode(null_encoding="encode")
                code, k = coded.indices.to_numpy(zero_copy_only=False), len(coded.dictionary)
                for n, (matches, totals) in enumerate(clipped(*numbers(sides), m, order), 1):
                    sums = [np.bincount(code, v, k).astype(np.int64) for v in (matches, *totals)]
                    yield pa.RecordBatch.from_arrays([coded.dictionary, pa.array([n] * k, pa.int32()), *map(pa.array, sums)], ["key", "n", "matches", "total_a", "total_b"])

    kind = df.schema[key].dataType.simpleString()
    counted = mapped(df.select(F.col(key).alias("key"), a.alias("a"), b.alias("b")), run, f"key {kind}, n int, matches long, total_a long, total_b long")
    sums = [F.sum(c).alias(c) for c in ("matches", "total_a", "total_b")]
    found = counted.groupBy("key", "n").agg(*sums)
    if overall is not None:
        found = found.withColumn("key", F.explode(F.array("key", F.lit(overall)))).groupBy("key", "n").agg(*sums)
    return found.withColumnRenamed("key", key)


def bleu(df: DataFrame, key: str, hypothesis: Column, reference: Column, order: int = 4, overall: str | None = None) -> DataFrame:
    """Corpus BLEU per key of token arrays: geometric mean of clipped precisions times the brevity penalty."""
    stats = ngram_matches(df, key, hypothesis, reference, order, overall)
    one = lambda c: F.sum(F.when(F.col("n") == 1, F.col(c)))
    precision = F.avg(F.when(F.col("matches") > 0, F.log(F.col("matches") / F.col("total_a"))))
    joined = stats.groupBy(key).agg(one("total_a").alias("h"), one("total_b").alias("r"), precision.alias("mean"), F.count(F.when(F.col("matches") > 0, 1)).alias("orders"))
    penalty = F.when(F.col("h") >= F.col("r"), 1.0).otherwise(F.exp(1 - F.col("r") / F.col("h")))
    return joined.select(key, F.when(F.col("orders") == order, 100 * penalty * F.exp("mean")).otherwise(0.0).alias("bleu"))


def chrf(df: DataFrame, key: str, hypothesis: Column, reference: Column, order: int = 6, beta: float = 2.0, overall: str | None = None) -> DataFrame:
    """Corpus chrF per key: character n-grams without white space, F score averaged over the orders."""
    solid = lambda c: F.regexp_replace(c, r"\s+", "")
    stats = ngram_matches(df, key, solid(hypothesis), solid(reference), order, overall).filter("total_a + total_b > 0")
    p, r = F.col("matches") / F.col("total_a"), F.col("matches") / F.col("total_b")
    f = F.when((F.col("total_a") > 0) & (F.col("total_b") > 0) & (F.col("matches") > 0), (1 + beta**2) * p * r / (beta**2 * p + r)).otherwise(0.0)
    return stats.groupBy(key).agg((100 * F.sum(f) / order).alias("chrf"))
