"""Materialising, global order and prefix sums without a single-partition window."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses the cluster's shared folder; only on a single machine, as in tests, a temporary one where none is set."""
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lexiloom-"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share."""
    ensure_checkpoint_dir(spark)
    return (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().get()).rstrip("/")


def held(df: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def prefix_sums(df: DataFrame, order: Sequence[str | Column], values: dict[str, str | Column]) -> DataFrame:
    """Adds for each ``name: value`` the sum of the value over all rows up to and including this one.

    Rows are range-partitioned by ``order`` (which should be total) and kept with their partition's
    number; a window sums inside each partition and the totals of the partitions, one row each, give
    the offsets. No task sees more than one partition's rows.
    """
    by = [F.col(c) if isinstance(c, str) else c for c in order]
    columns = df.columns
    ranged = held(df.repartitionByRange(*by).withColumn("__part", F.spark_partition_id()))
    totals = ranged.groupBy("__part").agg(*[F.sum(v).alias(f"__{k}") for k, v in values.items()])
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("__part"), *[F.coalesce(F.sum(f"__{k}").over(before), F.lit(0)).alias(f"__{k}") for k in values])
    inside = Window.partitionBy("__part").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    summed = ranged.select(*columns, "__part", *[F.sum(v).over(inside).alias(k) for k, v in values.items()])
    joined = summed.join(offsets, "__part")
    return joined.select(*columns, *[(F.col(k) + F.col(f"__{k}")).alias(k) for k in values])


def numbered_within(df: DataFrame, by: str, order: str, name: str) -> DataFrame:
    """Adds the row's place among those with the same ``by``, from 1; ``order`` tells them apart.

    Only these two columns are numbered, over ranges of both together, so neither a frequent value
    nor a long text meets a single task; a join on both brings the place back.
    """
    slim = numbered(df.select(F.col(by).alias("__by"), F.col(order).alias("__order")), ["__by", "__order"], "__at")
    first = slim.groupBy(F.col("__by").alias("__key")).agg(F.min("__at").alias("__first"))
    placed = slim.join(first, F.col("__by").eqNullSafe(F.col("__key"))).select("__by", "__order", (F.col("__at") - F.col("__first") + 1).alias("__place"))
    joined = df.join(placed, F.col(by).eqNullSafe(F.col("__by")) & F.col(order).eqNullSafe(F.col("__order")))
    return joined.withColumn(name, F.col("__place")).drop("__by", "__order", "__place")


def numbered(df: DataFrame, order: Sequence[str | Column], name: str = "rn") -> DataFrame:
    """Adds the row's place in the global order, from 1."""
    return prefix_sums(df, order, {name: F.lit(1).cast("long")})
