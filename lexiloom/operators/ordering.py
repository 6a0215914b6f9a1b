"""Interleaving, budgets, pools, shards and splits."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiloom.operators.frames import numbered, numbered_within, prefix_sums


def interleave(df: DataFrame, source: str, order: str) -> DataFrame:
    """Round robin over sources: adds ``rk``, the row's turn (in place of a column of that name); the order is (rk, source).

    ``order`` tells the rows of a source apart.
    """
    return numbered_within(df, source, order, "rk")


def first_n(df: DataFrame, n: int, by: str, order: str) -> DataFrame:
    """The first n rows of each source."""
    return interleave(df, by, order).filter(F.col("rk") <= n)


def stream_limit(df: DataFrame, n: int, source: str, order: str) -> DataFrame:
    """A prefix of the interleaved stream."""
    return interleave(df, source, order).orderBy("rk", source).limit(n)


def within_budget(df: DataFrame, budget: int, cost: Column, order: list[str], pool: int | None = None) -> DataFrame:
    """Rows until their cost reaches the budget, the crossing row included.

    With ``pool``, the budget is only looked at after every ``pool`` rows, so up to a pool more is kept.
    """
    summed = prefix_sums(df.withColumn("__cost", cost.cast("long")), order, {"upto": "__cost", "__rn": F.lit(1).cast("long")})
    ahead = F.col("upto") - F.col("__cost")
    if pool:
        block = F.floor((F.col("__rn") - 1) / pool)
        starts = summed.withColumn("__block", block).groupBy("__block").agg(F.min(ahead).alias("__first"))
        summed = summed.withColumn("__block", block).join(starts, "__block")
        return summed.filter(F.col("__first") < budget).drop("__cost", "__rn", "__block", "__first")
    return summed.filter(ahead < budget).drop("__cost", "__rn")


def length_buckets(df: DataFrame, order: list[str], size: Column, batch: int = 32, pool: int = 256) -> DataFrame:
    """Batches of similar length: pools of rows in order, sorted by length inside a pool."""
    rows = numbered(df.withColumn("__size", size), order).withColumn("pool", F.floor((F.col("rn") - 1) / pool))
    place = F.row_number().over(Window.partitionBy("pool").orderBy("__size", "rn"))
    return rows.withColumn("chunk", F.floor((place - 1) / batch)).drop("__size")


def shards(df: DataFrame, order: list[str], tokens: Column, shard_size: int) -> DataFrame:
    """First and last shard of every document's tokens in a stream cut at ``shard_size`` tokens."""
    rows = prefix_sums(df.withColumn("n_tokens", tokens.cast("long")), order, {"stop": "n_tokens"})
    start = F.col("stop") - F.col("n_tokens")
    return rows.withColumn("start", start).withColumn("first_shard", F.floor(F.col("start") / shard_size)).withColumn("last_shard", F.floor((F.greatest(F.col("stop"), F.col("start") + 1) - 1) / shard_size))


def stride_split(df: DataFrame, order: list[str], fraction: float) -> DataFrame:
    """Every stride-th row is for validation; none if the fraction is 0 or there are under two rows."""
    rows = numbered(df, order).withColumn("idx", F.col("rn") - 1).drop("rn")
    if fraction <= 0:
        return rows.withColumn("validation", F.lit(False))
    stride = max(round(1 / fraction), 2)
    two = rows.agg((F.count(F.lit(1)) > 1).alias("__two"))
    return rows.crossJoin(two).withColumn("validation", (F.col("idx") % stride == 0) & F.col("__two")).drop("__two")


def sampled(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """n rows without replacement, the same ones on every run."""
    mark = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    return df.withColumn("__mark", mark).orderBy("__mark", key).limit(n).drop("__mark")


def token_windows(shard_tokens: DataFrame, n: int, width: int, seed: int = 0) -> DataFrame:
    """n windows of width + 1 ids from rows (shard_id, ids), drawn by a hash; shards not longer than ``width`` are left out."""
    usable = numbered(shard_tokens.filter(F.size("ids") > width), ["shard_id"], "place")
    total = usable.agg(F.count(F.lit(1)).alias("n_shards"))
    draws = shard_tokens.sparkSession.range(n).crossJoin(F.broadcast(total)).filter("n_shards > 0")  # one row
    draws = draws.withColumn("place", F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.col("n_shards")) + 1)
    joined = draws.join(usable, "place")
    start = F.pmod(F.xxhash64(F.lit(seed + 1), F.col("id")), F.size("ids") - F.lit(width)).cast("int")
    return joined.select(F.col("id").alias("draw"), "shard_id", F.slice("ids", start + 1, width + 1).alias("window"))


def rotation(df: DataFrame, group: str, lang: str, seed: int = 0) -> DataFrame:
    """A fixed shuffled order of the languages in each group; visit k of a group takes entry k modulo their number."""
    mark = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(group).cast("string"), F.col(lang)))
    return df.withColumn("turn", F.row_number().over(Window.partitionBy(group).orderBy(mark, lang)) - 1)


def same_signature(groups: DataFrame, k: int) -> DataFrame:
    """Joins k groups that have the same languages: rows (signature, block, lang, text)."""
    keys = groups.groupBy("group_id").agg(F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("signature"))
    keys = keys.withColumn("block", F.floor((F.row_number().over(Window.partitionBy("signature").orderBy("group_id")) - 1) / k))
    rows = groups.join(keys, "group_id")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("group_id", "text"))), lambda s: s["text"]), " ")
    return rows.groupBy("signature", "block", "lang").agg(text.alias("text"))


def trend_flags(df: DataFrame, order: str, fairness: str, compression: str) -> DataFrame:
    """Whether each measure, and whether both, are lower than three windows before; not so where there is none."""
    w = Window.orderBy(order)
    falls = {f"{name}_falls": F.coalesce(F.col(c) < F.lag(c, 3).over(w), F.lit(False)) for name, c in (("fairness", fairness), ("compression", compression))}
    return df.withColumns(falls).withColumn("both_fall", F.col("fairness_falls") & F.col("compression_falls"))


def reward_to_go(df: DataFrame, episode: str, step: str, reward: str, discount: float) -> DataFrame:
    """Discounted sum of the rewards from each step on: one backward pass over each episode, which is a unit of its own."""
    schema = T.StructType([*df.schema.fields, T.StructField("to_go", T.DoubleType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(step, ascending=False, kind="stable")
        total, out = 0.0, []
        for r in pdf[reward].to_numpy(float):
            total = r + discount * total
            out.append(total)
        return pdf.assign(to_go=out)

    return df.groupBy(episode).applyInPandas(run, schema)


def group_advantage(df: DataFrame, group: str, lang: str, reward: str) -> DataFrame:
    """Reward less its group's baseline, the mean of the group's means by language."""
    means = df.groupBy(group, lang).agg(F.avg(reward).alias("__mean"))
    baseline = means.groupBy(F.col(group).alias("__group")).agg(F.avg("__mean").alias("__base"))
    joined = df.join(baseline, F.col(group).eqNullSafe(F.col("__group")))
    return joined.withColumn("advantage", F.col(reward) - F.col("__base")).drop("__group", "__base")


def latest_checkpoints(names: DataFrame, column: str, keep: int) -> DataFrame:
    """Checkpoint names with their step, and whether they are among the last ``keep``."""
    rows = names.withColumn("step", F.regexp_extract(column, r"(\d+)", 1).try_cast("long")).filter("step is not null")
    return rows.withColumn("kept", F.row_number().over(Window.orderBy(F.col("step").desc(), column)) <= keep)
