"""Mixing sources to target weights.

Every document gets a hash-random key. Within its source, documents stand in the order of that
key; the key's range is cut into as many equal buckets as keep a bucket near ``bucket_rows``
documents, so a source with a third of all rows is spread over many tasks. Word totals of the
buckets give each bucket's offset, a running sum inside the bucket gives each document's place,
and the source's budget cuts there, to the word. A budget over the source's size takes whole
epochs first. Words are counted in one pass over the texts; sizes and keys are kept as a table.

Defined cases: a null text has size 0 and is taken 0 words; documents without a source form one
source, ordered last; rows with equal ids and texts are separate documents with the same key
(equal rows are interchangeable); an empty table gives an empty mix; other columns are ignored
here and kept by ``repeat``. Of the document at the cut only the first words are taken, in
``repeat`` as a text of its own with single blanks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.llm.common import WORD, stage, text_or_empty, word_count

SPACE = 1 << 28


def mix_key(doc_id: Column, text: Column, seed: int) -> Column:
    """A document's key: 128 hash-random bits in hex, the same on every run."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), text).cast("binary"))


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5.0, 2.0, 1.0), epochs: float = 3.0) -> DataFrame:
    """Adds ``target`` to rows (source, source_size, n_docs): shares of the total by weight, none over ``epochs`` times its size.

    Reshaping excess by weight until none is above its cap ends where all uncapped sources have the
    same target per weight. With sources ordered by cap per weight, that level follows from running sums.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(order) - 1) % len(weights)
    weighed = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int")))
    weighed = weighed.withColumn("cap", F.lit(float(epochs)) * F.col("source_size"))
    rank = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, rest = rank.rowsBetween(Window.unboundedPreceding, -1), rank.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    # the level counts at the first source that it doesn't fill; those before are full
    filled = weighed.withColumn("level", level).withColumn("full", F.col("cap") <= F.col("level") * F.col("weight"))
    final = F.max(F.when(~F.col("full"), F.struct((-F.col("cap") / F.col("weight")).alias("near"), F.col("level").alias("level")))).over(Window.partitionBy())["level"]
    return filled.withColumn("final", final).select(
        "source", "source_size", "n_docs", F.when(F.col("full") | F.col("final").isNull(), F.col("cap")).otherwise(F.col("final") * F.col("weight")).alias("target")
    )


def plan(
    documents: DataFrame,
    weights: Sequence[float] = (5.0, 2.0, 1.0),
    epochs: float = 3.0,
    seed: int = 17,
    bucket_rows: int = 5000,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Rows (doc_id, source, check, size, source_size, target, copies, part), one per document; ``check`` is a hash of the text.

    A document is taken ``copies`` times as a whole, and ``part`` words of it once more (0 if none).
    """
    text = text_or_empty(F.col(text_col))
    slim = documents.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.xxhash64(text).alias("check"), word_count(text).alias("size"), mix_key(F.col(id_col), text, seed).alias("key"))
    slim = stage(slim, "sizes").withColumn("slot", F.conv(F.substring("key", 1, 7), 16, 10).cast("long"))
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    targets = source_targets(sizes, weights, epochs).withColumn("n_buckets", F.ceil(F.col("n_docs") / bucket_rows))
    same = lambda a, b: a.eqNullSafe(b)
    t = targets.withColumnRenamed("source", "t_source")
    placed = slim.join(t, same(slim["source"], t["t_source"])).drop("t_source").withColumn("bucket", F.floor(F.col("slot") * F.col("n_buckets") / SPACE))
    totals = placed.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("source").alias("o_source"), F.col("bucket").alias("o_bucket"), F.coalesce(F.sum("bucket_size").over(ahead), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("source", "bucket").orderBy("key", F.col("doc_id").asc_nulls_last(), "check").rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.withColumn("upto", F.sum("size").over(inside))
    joined = summed.join(offsets, same(summed["source"], offsets["o_source"]) & (summed["bucket"] == offsets["o_bucket"]))
    # a target that is a whole number but for rounding counts as that number
    budget = F.floor(F.col("target") + 1e-6)
    rounds = F.when(F.col("source_size") > 0, F.least(F.floor(budget / F.col("source_size")), F.lit(int(epochs)))).otherwise(F.lit(0))
    left = budget - F.col("rounds") * F.col("source_size") - (F.col("offset") + F.col("upto") - F.col("size"))
    more = F.greatest(F.lit(0), F.least(F.col("size"), left)).cast("long")
    full = F.when(F.col("size") == 0, left > 0).otherwise(more == F.col("size"))
    return (
        joined.withColumn("rounds", rounds.cast("int"))
        .withColumn("copies", (F.col("rounds") + full.cast("int")).cast("int"))
        .withColumn("part", F.when(full, F.lit(0)).otherwise(more).cast("long"))
        .select("doc_id", "source", "check", "size", "source_size", "target", "copies", "part")
    )


def mix(documents: DataFrame, **options) -> DataFrame:
    """``plan`` with ``taken``, the words that the mix takes of each document, repeats counted."""
    return plan(documents, **options).withColumn("taken", F.col("copies") * F.col("size") + F.col("part"))


def first_words(text: Column, n: Column) -> Column:
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lit(1), n), " ")


def repeat(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The mixed documents themselves, with all their columns: each as often as it is taken.

    The copies of rows that repeat id and text are dealt to these rows in turn, so their sum is exact.
    """
    copies = plan(documents, id_col=id_col, text_col=text_col, **options)
    copies = copies.groupBy(F.col("doc_id").alias("__id"), F.col("check").alias("__check")).agg(F.sum("copies").alias("__copies"), F.collect_list(F.when(F.col("part") > 0, F.col("part").cast("int"))).alias("__parts"), F.count(F.lit(1)).alias("__rows"))
    keyed = documents.withColumn("__hash", F.xxhash64(text_or_empty(F.col(text_col))))
    same = keyed[id_col].eqNullSafe(copies["__id"]) & (keyed["__hash"] == copies["__check"])
    alone = keyed.join(copies.filter("__rows = 1"), same).withColumn("__i", F.lit(1))
    place = F.row_number().over(Window.partitionBy("__id", "__check").orderBy("__rows"))
    several = keyed.join(copies.filter("__rows > 1"), same).withColumn("__i", place)
    rows = alone.unionByName(several)
    times = F.floor(F.col("__copies") / F.col("__rows")) + (F.col("__i") <= F.col("__copies") % F.col("__rows")).cast("int")
    whole = F.array_repeat(F.lit(None).cast("int"), times.cast("int"))
    cut = F.when(F.col("__i") == 1, F.col("__parts")).otherwise(F.array().cast("array<int>"))  # one from each source that has the row
    rows = rows.withColumn("__cut", F.explode(F.concat(whole, cut)))
    text = F.when(F.col("__cut").isNull(), F.col(f"`{text_col}`")).otherwise(first_words(F.col(f"`{text_col}`"), F.coalesce("__cut", F.lit(1))))
    return rows.select(*[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in documents.columns])
