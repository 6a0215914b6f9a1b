"""Near-duplicate documents by circulant MinHash.

One permutation places a shingle in a universe of ``UNIVERSE`` slots (the leading bits of its
mixed hash), a second one is a fixed permutation of the slots; coordinate k of a signature is the
least value of the second permutation, shifted by k, over the document's slots. Coordinates are
grouped in bands; documents that share a band are candidates, and every link is confirmed by the
exact Jaccard of full shingle sets.

Documents with equal sets are one vertex, so copies never meet each other. In each band's bucket
all members are first compared with one hub. Where a bucket then still holds several components,
pairs across components are compared if it is small; in a large one what is apart is compared
block by block with the rest of its group, so no link between components is lost and no pairs
are emitted.

Defined cases: null and blank texts have no shingles and link with nothing; rows without an id
keep a null component and are never kept; rows that share an id are one vertex; repeated rows
get the same result; tables may be empty; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.llm.common import blocks, cut, mapped, sorted_merge, stage
from lexiloom.llm.graph import SPLIT, components
from lexiloom.llm.shingles import U, mix, shingle_sets

BITS = 20
UNIVERSE = 1 << BITS
BANDS, ROWS = 40, 6
_tables: dict[tuple[int, int], np.ndarray] = {}


def permutation(seed: int, width: int) -> np.ndarray:
    """The second permutation as a table whose row p holds its values at p, p+1, ... p+width-1 (a view)."""
    if (seed, width) not in _tables:
        table = np.random.Generator(np.random.PCG64(seed)).permutation(UNIVERSE).astype(np.uint32)
        _tables[seed, width] = np.lib.stride_tricks.sliding_window_view(np.append(table, table[:width]), width)
    return _tables[seed, width]


def signature(shingles: np.ndarray, width: int, seed: int = 1) -> np.ndarray:
    slots = (mix(shingles + U(seed)) >> U(64 - BITS)).astype(np.int64)
    table = permutation(seed, width)
    least = np.full(width, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(slots), 2048):
        np.minimum(least, table[slots[at : at + 2048]].min(axis=0), out=least)
    return least


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band of each signature; the band's number is part of it."""
    with np.errstate(over="ignore"):
        parts = signatures.reshape(len(signatures), bands, rows).astype(np.uint64)
        keys = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), parts.shape[:2]).copy()
        for i in range(rows):
            keys = mix(keys * U(0x9E3779B97F4A7C15) + parts[:, :, i])
        return keys.view(np.int64)


def sketch(documents: DataFrame, n: int = 4, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_shingles, digest of the set, band keys)."""
    slim = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, "text", 1 << 20):
            with np.errstate(over="ignore"):
                sets = shingle_sets(part.column("text"), n)
                some = [i for i, s in enumerate(sets) if len(s)]
                keys = band_keys(np.stack([signature(sets[i], bands * rows) for i in some]), bands, rows) if some else np.empty((0, bands), np.int64)
            digest: list[bytes | None] = [None] * len(sets)
            for i in some:
                digest[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest()
            ends = np.cumsum([bands * bool(len(s)) for s in sets])
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), lists], names=["doc_id", "n_shingles", "digest", "bands"])

    return mapped(slim, run, "doc_id long, n_shingles long, digest binary, bands array<long>")


def shingle_table(documents: DataFrame, n: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (vertex, shingles): the sorted 64-bit hashes of each document's set, as bytes."""
    slim = documents.select(F.col(id_col).cast("long").alias("vertex"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, "text", 1 << 20):
            sets = shingle_sets(part.column("text"), n)
            yield pa.RecordBatch.from_arrays([part.column("vertex"), pa.array([s.tobytes() for s in sets], pa.binary())], names=["vertex", "shingles"])

    return mapped(slim, run, "vertex long, shingles binary")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) whose sets have 100 * intersection >= percent * union."""
    left = sets.select(F.col("vertex").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("vertex").alias("b"), F.col("shingles").alias("sb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sa, sb = batch.column("sa"), batch.column("sb")
            keep = []
            for i in range(batch.num_rows):
                x, y = np.frombuffer(sa[i].as_buffer(), np.uint64), np.frombuffer(sb[i].as_buffer(), np.uint64)
                small, large = sorted((len(x), len(y)))
                if 100 * small < percent * large or not large:
                    continue
                both = np.sort(np.concatenate((x, y)), kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                if 100 * common >= percent * (small + large - common):
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return mapped(pairs.join(sorted_merge(left), "a").join(sorted_merge(right), "b").select("a", "b", "sa", "sb"), run, "a long, b long")


def links_between(x: list[np.ndarray], y: list[np.ndarray], percent: int, columns: int = 1 << 14) -> np.ndarray:
    """Which sets of x link with which of y: intersection sizes by products of 0/1 matrices, some shingles at a time."""
    flat = lambda sets: (np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets]))
    (vx, ox), (vy, oy) = flat(x), flat(y)
    shared = np.intersect1d(vx, vy)
    common = np.zeros((len(x), len(y)))

    def dense(values: np.ndarray, owner: np.ndarray, part: np.ndarray, n: int) -> np.ndarray:
        at = np.minimum(np.searchsorted(part, values), len(part) - 1)
        hit = part[at] == values
        out = np.zeros((n, len(part)), np.float32)
        out[owner[hit], at[hit]] = 1
        return out

    for at in range(0, len(shared), columns):
        part = shared[at : at + columns]
        common += dense(vx, ox, part, len(x)) @ dense(vy, oy, part, len(y)).T
    union = np.array([len(s) for s in x])[:, None] + np.array([len(s) for s in y])[None, :] - common
    return 100 * common >= percent * union


def compare_blocks(members: DataFrame, sets: DataFrame, percent: int, block: int) -> DataFrame:
    """Links (a, b) between different labels of a large group, from rows (vertex, label, g).

    The members of a group's most frequent label and the others are dealt into blocks by a hash of
    the vertex; each other block meets every block of the group in a task of its own, so no pair of
    rows is ever emitted that isn't a link, and a task holds two blocks.
    """
    sizes = members.groupBy("g", "label").agg(F.count(F.lit(1)).alias("n"))
    groups = sizes.groupBy("g").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("all"))
    groups = groups.select("g", F.col("top.label").alias("main"), F.ceil(F.col("top.n") / block).cast("int").alias("mains"), F.ceil((F.col("all") - F.col("top.n")) / block).cast("int").alias("others")).filter("others > 0")
    hashed = F.xxhash64("vertex")
    many = groups.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SPLIT - 1))))  # the largest group is no hot key
    rows = members.withColumn("part", F.pmod(F.shiftright(hashed, 32), F.lit(SPLIT)).cast("int")).join(sorted_merge(many), ["g", "part"])
    rows = rows.withColumn("other", F.col("label") != F.col("main"))
    rows = rows.withColumn("own", F.when(F.col("other"), F.pmod(hashed, F.col("others"))).otherwise(F.col("others") + F.pmod(hashed, F.col("mains"))).cast("int"))
    meets = F.when(F.col("other"), F.sequence(F.lit(0), F.col("others") + F.col("mains") - 1)).otherwise(F.sequence(F.lit(0), F.col("others") - 1))
    dealt = rows.withColumn("met", F.explode(meets)).select("g", "vertex", "label", "own", F.least("own", "met").alias("i"), F.greatest("own", "met").alias("j"))
    dealt = dealt.join(sorted_merge(sets), "vertex")

    def run(pdf):
        import pandas as pd

        i, j = pdf["i"].iloc[0], pdf["j"].iloc[0]
        one, two = pdf[pdf["own"] == i], pdf[pdf["own"] == j]
        if not len(one) or not len(two):
            return pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64")})
        arrays = lambda p: [np.frombuffer(s, np.uint64) for s in p["shingles"]]
        linked = links_between(arrays(one), arrays(two), percent) & (one["label"].to_numpy()[:, None] != two["label"].to_numpy()[None, :])
        x, y = np.nonzero(linked)
        return pd.DataFrame({"a": one["vertex"].to_numpy()[x], "b": two["vertex"].to_numpy()[y]})

    return dealt.groupBy("g", "i", "j").applyInPandas(run, "a long, b long")


def group(
    documents: DataFrame, n: int = 4, percent: int = 80, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text", small: int = 24, block: int = 128
) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, kept), one per document."""
    sketches = stage(sketch(documents, n, bands, rows, id_col, text_col), "sketch")
    some = sketches.filter("digest is not null and doc_id is not null")
    classes = cut(some.groupBy("digest").agg(F.min("doc_id").alias("vertex")))
    ids = classes.select(F.col("vertex").alias("doc_id")).distinct()
    keyed = some.join(sorted_merge(ids), "doc_id", "left_semi").select(F.explode("bands").alias("band"), F.col("doc_id").alias("vertex"))
    shared = keyed.groupBy("band").agg(F.min("vertex").alias("hub"), F.max("vertex").alias("other")).filter("hub != other").select("band", "hub")
    buckets = cut(keyed.join(sorted_merge(shared), "band").select("band", "vertex", "hub"))
    wanted = buckets.select(F.col("vertex").alias("doc_id")).distinct()
    texts = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(sorted_merge(wanted), "doc_id", "left_semi")
    sets = stage(shingle_table(texts, n, "doc_id", "text").filter("octet_length(shingles) > 0"), "sets")

    first = buckets.filter("vertex != hub").select(F.col("vertex").alias("a"), F.col("hub").alias("b")).distinct()
    found = components(confirm(first, sets, percent))
    # buckets that still hold several components: small ones by pairs, large ones by blocks
    placed = buckets.join(sorted_merge(found.select("vertex", F.col("component").alias("label"))), "vertex", "left").withColumn("label", F.coalesce("label", "vertex"))
    split = placed.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("m")).filter("low != high")
    open_ = cut(placed.join(sorted_merge(split.select("band", "m")), "band"))
    few = open_.filter(F.col("m") <= small)
    x, y = few.select("band", F.col("vertex").alias("a"), F.col("label").alias("la")), few.select("band", F.col("vertex").alias("b"), F.col("label").alias("lb"))
    pairs = x.join(sorted_merge(y), "band").filter("a > b and la != lb").select("a", "b").distinct().join(sorted_merge(first), ["a", "b"], "left_anti")
    many = open_.filter(F.col("m") > small)
    tied = components(many.select(F.col("vertex").alias("a"), F.col("hub").alias("b")))
    members = many.select("vertex", "label").distinct().join(sorted_merge(tied.withColumnRenamed("component", "g")), "vertex")
    more = confirm(pairs, sets, percent).union(compare_blocks(members, sets, percent, block))
    found = components(found.select(F.col("vertex").alias("a"), F.col("component").alias("b")).union(more))
    labelled = classes.join(sorted_merge(found), "vertex", "left").select("digest", F.coalesce("component", "vertex").alias("component"))
    out = sketches.select("doc_id", "n_shingles", "digest").join(sorted_merge(labelled), "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def drop_near(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents, one row of each group, with all their columns.

    A row without an id takes part like any other, behind all ids, under a number made of its text.
    Of rows with the same id the one with the least hash of its text stays.
    """
    own = F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))), 2).bitwiseOR(F.lit(1 << 62))
    keyed = documents.withColumn("__vertex", F.coalesce(F.col(id_col).cast("long"), own))
    kept = group(keyed, id_col="__vertex", text_col=text_col, **options).filter("kept").select(F.col("doc_id").alias("__id")).distinct()
    first = F.row_number().over(Window.partitionBy("__vertex").orderBy(F.xxhash64(text_col)))
    joined = keyed.join(sorted_merge(kept), F.col("__vertex") == F.col("__id"), "left_semi").withColumn("__place", first)
    return joined.filter("__place = 1").select(*[F.col(f"`{c}`") for c in documents.columns])
