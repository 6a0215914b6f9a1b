"""Connected components of a table of links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import cut, mapped, sorted_merge, stage


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b")


#: Tasks among which the neighbours of one vertex are dealt.
SPLIT = 16


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Edges with the least neighbour (u, m) of their vertex a. The centre of a large star is no hot key: its edges are dealt out by their other end."""
    dealt = least.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SPLIT - 1))))
    return edges.withColumn("own", F.pmod(F.xxhash64("b"), F.lit(SPLIT)).cast("int")).join(sorted_merge(dealt), (F.col("a") == F.col("u")) & (F.col("own") == F.col("part")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each vertex ties its larger neighbours to its least neighbour (or itself)."""
    near = _both(edges)
    least = near.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _with_least(near, least).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each vertex ties itself and its smaller neighbours to the least of them; edges point down (a > b)."""
    least = edges.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
    tied = _with_least(edges, least).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return tied.union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).filter("a != b").distinct()


#: Edges that one task settles at most (16 bytes each); with more, rounds over all tasks go first.
ALONE = 1 << 20


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components as edges from each vertex to the least that it reaches; that one has no edge."""
    ids, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(ids))
    while len(x):
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))  # x and y are roots: those with a lesser neighbour hang below it
        while (up := root[root]).tobytes() != root.tobytes():
            root = up
        x, y = root[x], root[y]
        x, y = x[x != y], y[x != y]
    low = root != np.arange(len(ids))
    return ids[low], ids[root[low]]


def contracted(edges: DataFrame, roots: bool = False) -> DataFrame:
    """Edges (a, b), a > b, with the same components: of each task's edges one for each of its vertices at most; with ``roots`` each b has a row (b, b) too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, most = [], 0, ALONE
        for batch in batches:
            held.append((batch.column("a").to_numpy(), batch.column("b").to_numpy()))
            n += batch.num_rows
            if n > most:
                held = [stars(*map(np.concatenate, zip(*held, strict=True)))]
                n = len(held[0][0])
                most = max(most, 2 * n)
        if held:
            a, b = stars(*map(np.concatenate, zip(*held, strict=True)))
            if roots:
                a, b = np.append(a, own := np.unique(b)), np.append(b, own)
            for i in range(0, len(a), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(a[i : i + (1 << 16)]), pa.array(b[i : i + (1 << 16)])], names=["a", "b"])

    return mapped(edges, run, "a long, b long")


def components(edges: DataFrame, left: str = "a", right: str = "b", rounds: int = 60, alone: int = ALONE) -> DataFrame:
    """Rows (vertex, component): every linked vertex and the least vertex that it reaches; ids are 64-bit numbers.

    Each task first contracts its own edges. Up to ``alone`` edges are then settled in one task,
    since rounds of shuffles over few rows cost their tasks only. With more, large-star and
    small-star steps alternate until so few are left or the edges are stars; each round's edges go
    to the shared folder. Nulls and loops link nothing; an empty table has no rows.
    """
    pairs = edges.select(F.greatest(left, right).alias("a"), F.least(left, right).alias("b")).filter(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col(left) != F.col(right)))
    held = stage(contracted(pairs), "edges")
    mark = None
    for _ in range(rounds):
        now = held.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now[0] <= alone:
            return stage(contracted(held.coalesce(1), roots=True).select(F.col("a").alias("vertex"), F.col("b").alias("component")), "components")
        if now == mark:
            return held.select(F.col("a").alias("vertex"), F.col("b").alias("component")).union(held.select(F.col("b"), F.col("b"))).distinct()
        mark = now
        held = cut(_small_star(_large_star(held)))
    raise RuntimeError("components did not settle")
