"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature is cut into bins at quantiles of the fitting rows. Boosting goes round the features
in turn; each step fits a shallow tree to one feature's binned gradients and adds its leaves to
that feature's lookup table. The strongest pairs of features (by the loss that a coarse two-way
split would still save) then get two-way tables in the same way. A score is the logistic function
of the sum of table entries, read for many documents at once.

Features come from the whole text only. The model is fitted on the driver on at most
``max_rows`` labelled rows (those of the least hash of their id), which bounds its size; features
are computed, and scores given, for all documents.

Defined cases: null and empty texts have all features 0 and get a score like any other; rows
without a label aren't learnt from; several labels of a document are separate rows; without any
labelled row every score is the prior 0.5; tables may be empty; extra columns are ignored or kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiloom.llm.common import blocks, mapped, stage

FEATURES = (
    "log_bytes", "log_words", "word_length", "distinct_words", "repeated_next", "distinct_pairs", "upper", "digits", "spaces",
    "marks", "exclaims", "bars", "symbols", "high_bytes", "lines", "distinct_lines", "top_word", "entropy", "sentences", "long_words",
)
_CLASS = np.zeros((256, 8), np.float64)
for _i, _chars in enumerate([b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\r\x0b\x0c", b".,;:'\"?()-", b"!", b"|", b"#$%&*+/<=>@[\\]^_`{}~"]):
    _CLASS[list(_chars), _i] = 1
_CLASS[128:, 7] = 1


def features(text: str) -> np.ndarray:
    """The FEATURES of one text."""
    out = np.zeros(len(FEATURES))
    data = text.encode("utf-8", "replace")
    words = text.split()
    if not words:
        out[0] = np.log1p(len(data))
        return out
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    n, w = len(data), len(words)
    upper, digits, spaces, marks, exclaims, bars, symbols, high = counts @ _CLASS / n
    tally: dict[str, int] = {}
    for word in words:
        tally[word] = tally.get(word, 0) + 1
    ahead = words[1:]
    lines = text.split("\n")
    share = counts[counts > 0] / n
    out[:] = (
        np.log1p(n), np.log1p(w), (n - counts[32]) / w, len(tally) / w, sum(map(str.__eq__, words, ahead)) / w, len(set(zip(words, ahead, strict=False))) / w,
        upper, digits, spaces, marks, exclaims, bars, symbols, high, len(lines) / w, len(set(lines)) / len(lines), max(tally.values()) / w,
        -(share * np.log2(share)).sum(), counts[46] / w, sum(len(x) > 12 for x in tally) / len(tally),
    )
    return out


def feature_rows(texts: list[str | None]) -> np.ndarray:
    return np.stack([features(t or "") for t in texts]) if texts else np.empty((0, len(FEATURES)))


@dataclass
class Model:
    """Bin edges by feature, lookup tables by feature, two-way tables by pair of features."""

    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]
    coarse: list[np.ndarray]
    intercept: float

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        bins = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)]
        for j, t in enumerate(self.tables):
            total += t[bins[j]]
        for (a, b), t in zip(self.pairs, self.pair_tables, strict=True):
            total += t[self.coarse[a][bins[a]], self.coarse[b][bins[b]]]
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def _gain(g: np.ndarray, h: np.ndarray, least: float) -> np.ndarray:
    return g * g / (h + least)


def shallow(g: np.ndarray, h: np.ndarray, leaves: int, least: float = 1.0) -> np.ndarray:
    """Leaf values by bin of a tree of at most ``leaves`` leaves on binned gradients."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        best = (1e-9, None, None)
        for a, b in parts:
            if b - a < 2:
                continue
            cg, ch = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
            tg, th = g[a:b].sum(), h[a:b].sum()
            save = _gain(cg, ch, least) + _gain(tg - cg, th - ch, least) - _gain(tg, th, least)
            save[(ch < least) | (th - ch < least)] = -1
            k = int(save.argmax())
            if save[k] > best[0]:
                best = (save[k], (a, b), a + k + 1)
        if best[1] is None:
            break
        parts.remove(best[1])
        parts += [(best[1][0], best[2]), (best[2], best[1][1])]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + least)
    return out


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 80, rate: float = 0.15, leaves: int = 4, n_pairs: int = 8, pair_bins: int = 6, pair_rounds: int = 40) -> Model:
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.empty(0) for j in range(x.shape[1])]
    coarse = [np.minimum(np.arange(len(e) + 1) * pair_bins // (len(e) + 1), pair_bins - 1) for e in edges]
    model = Model(edges, [np.zeros(len(e) + 1) for e in edges], [], [], coarse, 0.0)
    if not len(y) or y.min() == y.max():
        model.intercept = 0.0 if not len(y) else float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        return model
    model.intercept = float(np.log(y.mean() / (1 - y.mean())))
    binned = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(edges)]
    total = np.full(len(y), model.intercept)
    for _ in range(rounds):
        for j, b in enumerate(binned):
            p = 1 / (1 + np.exp(-total))
            size = len(model.tables[j])
            step = rate * shallow(np.bincount(b, y - p, size), np.bincount(b, p * (1 - p), size), leaves)
            model.tables[j] += step
            total += step[b]
    p = 1 / (1 + np.exp(-total))
    ranked = []
    for a in range(len(edges)):
        for b in range(a + 1, len(edges)):
            cell = coarse[a][binned[a]] * pair_bins + coarse[b][binned[b]]
            g, h = np.bincount(cell, y - p, pair_bins**2), np.bincount(cell, p * (1 - p), pair_bins**2)
            ranked.append((_gain(g, h, 1.0).sum(), a, b))
    model.pairs = [(a, b) for _, a, b in sorted(ranked, reverse=True)[:n_pairs]]
    model.pair_tables = [np.zeros((pair_bins, pair_bins)) for _ in model.pairs]
    for _ in range(pair_rounds):
        for k, (a, b) in enumerate(model.pairs):
            p = 1 / (1 + np.exp(-total))
            ca, cb = coarse[a][binned[a]], coarse[b][binned[b]]
            cell = ca * pair_bins + cb
            g, h = (np.bincount(cell, v, pair_bins**2).reshape(pair_bins, -1) for v in (y - p, p * (1 - p)))
            rows = shallow(g.sum(1), h.sum(1), 2)  # first a cut along one feature, then one along the other on each side
            step = np.zeros_like(g)
            for value in np.unique(rows):
                side = rows == value
                step[side] = rate * shallow(g[side].sum(0), h[side].sum(0), 2)
            model.pair_tables[k] += step
            total += step[ca, cb]
    return model


def feature_table(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, features), one per document."""
    slim = documents.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = T.StructType([slim.schema["doc_id"], T.StructField("features", T.ArrayType(T.DoubleType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, "text"):
            x = feature_rows(part.column("text").to_pylist())
            ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(ends, pa.array(x.ravel()))], names=["doc_id", "features"])

    return mapped(slim, run, schema)


def held_out(id_column) -> object:
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(table: DataFrame, labels: DataFrame, max_rows: int = 20_000, label_col: str = "quality", **options) -> Model:
    """Fits on rows of ``feature_table`` that have a label and aren't held out, at most ``max_rows``."""
    known = labels.select(F.col("doc_id").alias("__id"), F.col(label_col).cast("int").alias("label")).filter("label is not null")
    rows = table.join(known, F.col("doc_id") == F.col("__id")).filter(~held_out(F.col("doc_id")))
    rows = rows.select("features", "label", F.xxhash64(F.col("doc_id")).alias("h")).orderBy("h", "label").limit(max_rows).collect()
    x = np.array([r["features"] for r in rows], np.float64).reshape(len(rows), len(FEATURES))
    return fit(x, np.array([r["label"] for r in rows], np.float64), **options)


def score_table(table: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted)."""
    schema = T.StructType([table.schema["doc_id"], T.StructField("score", T.DoubleType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column("features").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(flat))], names=["doc_id", "score"])

    scored = mapped(table.select("doc_id", "features"), run, schema)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def classify(documents: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    table = stage(feature_table(documents), "features")
    return score_table(table, learn(table, labels, **options), threshold)


def keep_good(documents: DataFrame, labels: DataFrame, threshold: float = 0.3, text_col: str = "text", **options) -> DataFrame:
    """The documents that the classifier doesn't reject, with all their columns, in one more pass over the texts."""
    table = stage(feature_table(documents, text_col=text_col), "features")
    model = learn(table, labels, **options)
    place, names = documents.columns.index(text_col), documents.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            good = model.score(feature_rows(part.column(place).to_pylist())) >= threshold
            yield pa.RecordBatch.from_arrays(part.filter(pa.array(good)).columns, names=names)

    return mapped(documents, run, documents.schema)
