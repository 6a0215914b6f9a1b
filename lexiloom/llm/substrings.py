"""Removal of repeated passages, found by recompression.

Recompression renames a document's words level by level: first every maximal run of one word
becomes a symbol, then at each level every pair of a left and a right symbol does. A symbol's side
and the name of a pair are hashes of what they stand for, so a name is global: equal passages get
equal symbols away from their ends, in whatever task. With each symbol goes the stretch of words
that decides its name, whatever stands outside it; a symbol is inside a window of ``width`` words
if that stretch is.

Each entry of ``levels`` is a Spark round. It names the words of all stretches that are left to
that many levels and counts the names over all documents. Every symbol inside a repeated window
occurs at least twice, so a window with a lonely symbol inside can't be repeated; windows without
one stand on as stretches for the next round. Lonely names have a single owner, so the count itself
finds it and no common name is ever joined to its occurrences.

What stands after the last round is verified on its words: windows are counted under 128-bit
digests of all their words, and those that are there once are struck out the same way. Documents
with equal word sequences are one class: their windows are repeated without counting, and one of
them stands for all in the rounds.

Symbols have 64 bits (two that are confused let a window stand until it is verified), documents
and windows 128 bits (n windows are confused with a chance of n*n/2**129).

Defined cases: null and blank texts have no words; documents under ``width`` words lose nothing;
repeated rows and rows without an id are documents like others; tables may be empty; other
columns are ignored. A word is never part of two documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import blocks, cut, mapped, stage, text_or_empty
from lexiloom.llm.shingles import U, document_bounds, folded, mix, text_bytes, words

LEVELS = (6, 4)
PAIR, RUN = U(0xA24BAED4963EE407), U(0x9FB21C651E98DF25)
KEY = ("key", "check")
OPEN = "key long, check long, copies long, text string, first array<int>, last array<int>"


class Names:
    """Symbols of stretches of words after some levels of naming; stretch k has the words from ``bounds[k]`` to ``bounds[k + 1]``."""

    def __init__(self, hashes: np.ndarray, bounds: np.ndarray, width: int, levels: int):
        self.width, sizes = width, np.diff(bounds)
        per = np.maximum(sizes - width + 1, 0)
        self.stretch = np.repeat(np.arange(len(sizes)), per)
        self.windows = np.arange(int(per.sum())) - np.repeat(np.cumsum(per) - per, per) + np.repeat(bounds[:-1], per)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        low, high = bounds[:-1] - 1, bounds[1:] + 1  # outside the stretch
        sym, at = hashes, np.arange(len(owner))
        joined = np.append((sym[1:] == sym[:-1]) & (owner[1:] == owner[:-1]), False)
        head = np.flatnonzero(~np.append(False, joined[:-1]))
        size = np.diff(np.append(head, len(sym)))
        own = owner[head]
        first, last = np.append(True, own[1:] != own[:-1]), np.append(own[1:] != own[:-1], True)
        left = np.where(first, low[own], at[head] - 1)
        right = np.where(last, high[own], at[head] + size + 1)
        sym = np.where(size > 1, mix(sym[head] * RUN + size.astype(np.uint64)), sym[head])
        for k in range(levels):
            opens = (mix(sym + U(k + 1)) & U(1)).astype(bool)
            inner = np.append(own[1:] == own[:-1], False)
            pair = opens & inner & np.append(~opens[1:], False)
            second = np.append(False, pair[:-1])
            after, before = np.append(right[1:], 0), np.append(0, left[:-1])
            new_right = np.where(pair, after, np.where(opens, np.where(inner, after, high[own]), right))
            new_left = np.where(~opens & ~second, np.where(np.append(False, inner[:-1]), before, low[own]), left)
            name = np.where(pair, mix(mix(sym * PAIR + U(k)) + np.append(sym[1:], U(0))), sym)
            keep = ~second
            sym, left, right, own = name[keep], new_left[keep], new_right[keep], own[keep]
        self.sym, self.left, self.right, self.own, self.n = sym, left, right, own, len(hashes)

    def standing(self, lonely: np.ndarray) -> np.ndarray:
        """Which windows have none of the symbols that ``lonely`` marks inside."""
        p, before = self.windows, np.append(0, np.cumsum(lonely))
        lo = np.append(0, np.cumsum(np.bincount(self.left + 1, minlength=self.n + 2)))[p + 1]
        hi = np.cumsum(np.bincount(self.right, minlength=self.n + 3))[p + self.width]
        return (hi <= lo) | (before[np.maximum(hi, lo)] == before[lo])


def stretches_of(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of all stretches of a batch's texts, their bounds, and each stretch's row and first word.

    A stretch is given by its first and last window; without these columns the whole text is one.
    """
    data, offsets = text_bytes(part.column("text"))
    hashes, start, _ = words(data, offsets, lower=False)
    bounds = document_bounds(start, offsets)
    if "first" not in part.schema.names:
        return hashes, bounds, np.arange(len(part)), np.zeros(len(part), np.int64)
    lists = part.column("first")
    row = np.repeat(np.arange(len(part)), np.diff(lists.offsets.to_numpy()))
    first, stop = (part.column(c).flatten().to_numpy().astype(np.int64) for c in ("first", "last"))
    return hashes, bounds, row, np.stack((first, stop), 1)


def spread(part: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of a batch's stretches side by side: hashes, bounds, row and first word of each stretch."""
    hashes, bounds, row, ends = stretches_of(part)
    if ends.ndim == 1:
        return hashes, bounds, row, ends
    size = ends[:, 1] - ends[:, 0] + width
    to = np.append(0, np.cumsum(size))
    from_ = np.arange(to[-1]) - np.repeat(to[:-1] - bounds[row] - ends[:, 0], size)
    return hashes[from_], to, row, ends[:, 0]


def lists_by(row: np.ndarray, n: int, *values: pa.Array) -> list[pa.ListArray]:
    """Values that stand in the order of their rows as lists, one for each of ``n`` rows."""
    ends = pa.array(np.append(0, np.cumsum(np.bincount(row, minlength=n))), pa.int32())
    return [pa.ListArray.from_arrays(ends, v) for v in values]


def survey(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, key, check, n_words, sha, class), one per document."""
    slim = keyed(documents, text_col, F.col(id_col).alias("doc_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, "text", 1 << 20):
            split = [text.as_buffer().to_pybytes().split() for text in part.column("text")]
            joined = [b" ".join(w) for w in split]
            sha = pa.array([hashlib.sha256(j).hexdigest() for j in joined])
            same = pa.array([hashlib.blake2b(j, digest_size=16).digest() for j in joined])
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("doc_id", *KEY)], pa.array([len(w) for w in split], pa.int64()), sha, same], names=["doc_id", *KEY, "n_words", "sha", "class"])

    kind = slim.schema["doc_id"].dataType.simpleString()
    return mapped(slim, run, f"doc_id {kind}, key long, check long, n_words long, sha string, class binary")


def keyed(documents: DataFrame, text_col: str, *columns: Column) -> DataFrame:
    """``columns``, two hashes of the text that together name a document, and the text."""
    text = text_or_empty(F.col(text_col))
    return documents.select(*columns, F.xxhash64(text).alias("key"), F.xxhash64(F.lit(7), text).alias("check"), text.alias("text"))


def names(texts: DataFrame, width: int, levels: int) -> DataFrame:
    """Rows (symbol, key, times): the symbols of the texts' stretches that can be inside a window."""
    columns = [c for c in ("key", "text", "first", "last") if c in texts.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for part in blocks(batches, "text", 1 << 20):
                hashes, bounds, row, _ = spread(part, width)
                found = Names(hashes, bounds, width, levels) if len(hashes) else None
                if found is None or not len(found.windows):
                    continue
                fits = np.flatnonzero(found.right - found.left <= width)
                owner = row[found.own[fits]]
                salt = mix(np.arange(1, len(part) + 1, dtype=np.uint64))
                _, at, times = np.unique(mix(found.sym[fits]) ^ salt[owner], return_index=True, return_counts=True)
                columns_ = found.sym[fits][at].view(np.int64), np.asarray(part.column("key"))[owner[at]], times.astype(np.int32)
                for i in range(0, len(at), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(x[i : i + (1 << 16)]) for x in columns_], names=["symbol", "key", "times"])

    return mapped(texts.select(*columns), run, "symbol long, key long, times int")


def lonely(found: DataFrame) -> DataFrame:
    """Rows (key, alone): the symbols that occur once in all documents, by the document they are in."""
    once = found.groupBy("symbol").agg(F.sum("times").alias("n"), F.min("key").alias("key")).filter("n = 1")
    return cut(once.groupBy("key").agg(F.collect_list("symbol").alias("alone")))


def narrow(texts: DataFrame, width: int, levels: int) -> DataFrame:
    """The texts that have standing windows left, with these as new stretches, from texts with ``alone``."""
    columns = [c for c in (*KEY, "copies", "text", "first", "last", "alone") if c in texts.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for part in blocks(batches, "text", 1 << 20):
                hashes, bounds, row, first = spread(part, width)
                found = Names(hashes, bounds, width, levels) if len(hashes) else None
                if found is None or not len(found.windows):
                    continue
                salt = mix(np.arange(1, len(part) + 1, dtype=np.uint64))
                lists = part.column("alone")
                alone = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                alone = np.sort(mix(alone) ^ salt[np.repeat(np.arange(len(part)), np.diff(lists.offsets.to_numpy()))])
                mine = mix(found.sym) ^ salt[row[found.own]]
                hit = alone[np.minimum(np.searchsorted(alone, mine), len(alone) - 1)] == mine if len(alone) else np.zeros(len(mine), bool)
                at = np.flatnonzero(found.standing(hit))
                if not len(at):
                    continue
                stretch, place = found.stretch[at], found.windows[at] - bounds[found.stretch[at]] + first[found.stretch[at]]
                opens = np.append(True, (stretch[1:] != stretch[:-1]) | (place[1:] != place[:-1] + 1))
                closes = np.append(opens[1:], True)
                of = row[stretch[opens]]
                ends = lists_by(of, len(part), *[pa.array(x.astype(np.int32)) for x in (place[opens], place[closes])])
                out = pa.RecordBatch.from_arrays([*[part.column(c) for c in (*KEY, "copies", "text")], *ends], names=[*KEY, "copies", "text", "first", "last"])
                yield out.take(pa.array(np.unique(of)))

    return mapped(texts.select(*columns), run, OPEN)


def windows(texts: DataFrame, width: int) -> DataFrame:
    """Rows (high, low, key, check, place): the digests of all windows of the texts' stretches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for part in blocks(batches, "text", 1 << 20):
                hashes, bounds, row, first = spread(part, width)
                found = Names(hashes, bounds, width, 0)
                owner, at = row[found.stretch], found.windows
                high, low = (folded(mix(hashes + U(salt)), width, salt)[at].view(np.int64) for salt in (0, 9))
                place = (at - bounds[found.stretch] + first[found.stretch]).astype(np.int32)
                columns = [high, low, *[np.asarray(part.column(c))[owner] for c in KEY], place]
                for i in range(0, len(at), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(x[i : i + (1 << 16)]) for x in columns], names=["high", "low", *KEY, "place"])

    return mapped(texts.select(*KEY, "text", "first", "last"), run, "high long, low long, key long, check long, place int")


def without(texts: DataFrame, width: int) -> DataFrame:
    """Rows (key, check, kept, n_removed): texts without their standing windows, those at ``single`` places left alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, "text", 1 << 20):
            kept_text, removed = [], []
            for text, first, last, single in zip(*[part.column(c) for c in ("text", "first", "last", "single")], strict=True):
                tokens = text.as_buffer().to_pybytes().split()
                starts = np.zeros(len(tokens) + 1, np.int64)
                np.add.at(starts, np.asarray(first.values), 1)
                np.add.at(starts, np.asarray(last.values) + 1, -1)
                repeated = np.cumsum(starts) > 0
                repeated[np.asarray(single.values, np.int64)] = False
                change = np.zeros(len(tokens) + 1, np.int64)
                at = np.flatnonzero(repeated)
                change[at] += 1
                change[at + width] -= 1
                keep = np.cumsum(change[:-1]) == 0
                kept_text.append(b" ".join([t for t, k in zip(tokens, keep.tolist(), strict=True) if k]))
                removed.append(int(len(tokens) - keep.sum()))
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in KEY], pa.array(kept_text, pa.binary()).cast(pa.string()), pa.array(removed, pa.int64())], names=[*KEY, "kept", "n_removed"])

    return mapped(texts.select(*KEY, "text", "first", "last", "single"), run, "key long, check long, kept string, n_removed long")


def remove_repeats(documents: DataFrame, width: int = 35, levels: Sequence[int] = LEVELS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_words, n_removed, kept, kept_sha256); ``kept`` is null where nothing is removed (the text's words stay as they are)."""
    none = lambda kind: F.array().cast(f"array<{kind}>")
    table = stage(survey(documents, id_col, text_col), "survey")
    classes = table.filter(F.col("n_words") >= width).groupBy("class").agg(F.min(F.struct("doc_id", *KEY)).alias("least"), F.count(F.lit(1)).alias("copies"))
    classes = cut(classes.select("class", F.col("least.doc_id").alias("of"), *[f"least.{c}" for c in KEY], "copies"))
    texts = keyed(documents, text_col, F.col(id_col).alias("doc_id"))
    for k, level in enumerate(levels):
        alone = lonely(names(texts, width, level))
        if k:
            texts = texts.join(alone, "key", "left")
        else:  # one row of each class goes on
            wanted = classes.drop("class").join(alone, "key", "left")
            texts = texts.join(wanted, [*KEY]).filter(F.col("doc_id").eqNullSafe(F.col("of")))
        texts = texts.withColumn("alone", F.coalesce("alone", none("long")))
        texts = stage(narrow(texts, width, level), f"stretches{k}")
        del alone
    single = windows(texts, width).groupBy("high", "low").agg(F.count(F.lit(1)).alias("n"), *[F.min(c).alias(c) for c in (*KEY, "place")]).filter("n = 1")
    single = single.groupBy(*KEY).agg(F.collect_list("place").alias("single"))
    left = texts.filter("copies = 1").join(single, [*KEY], "left").withColumn("single", F.coalesce("single", none("int")))
    left = without(left, width).filter("n_removed > 0").withColumn("kept_sha", F.sha2("kept", 256))
    copied = classes.filter("copies > 1").select("class", "copies")
    out = table.join(copied, "class", "left").join(left, [*KEY], "left")
    whole = F.col("copies").isNotNull()
    return out.select(
        "doc_id",
        "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.lit("")).otherwise(F.col("kept")).alias("kept"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha", "sha")).alias("kept_sha256"),
    )
