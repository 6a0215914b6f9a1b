"""Structured Streaming forms of deduplication and accounting over files."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiloom.functions.text import exact_key, pretokens
from lexiloom.operators.frames import prefix_sums, shared_folder


def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 16) -> DataFrame:
    """A stream of the Parquet files of a folder (or of one file); the file system tells which, as a folder's name may end like a file's."""
    folder, _, name = path.rstrip("/").rpartition("/")
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    one = place.getFileSystem(spark._jsc.hadoopConfiguration()).isFile(place)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    return stream.option("pathGlobFilter", name).parquet(folder) if one else stream.parquet(path)


def unique_texts(stream: DataFrame, text: str = "text") -> DataFrame:
    """First occurrence of each normalised text; the state is one key per text."""
    return stream.withColumn("key", exact_key(F.col(text))).dropDuplicates(["key"])


def unique_within(stream: DataFrame, time: str, delay: str, text: str = "text") -> DataFrame:
    """The same with bounded state: repeats further apart than the delay may pass."""
    return stream.withColumn("key", exact_key(F.col(text))).withWatermark(time, delay).dropDuplicatesWithinWatermark(["key"])


def token_counts(stream: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """Running documents, tokens and bytes by language."""
    return stream.groupBy(lang).agg(F.count(F.lit(1)).alias("docs"), F.sum(F.size(pretokens(F.col(text)))).cast("long").alias("tokens"), F.sum(F.octet_length(text)).cast("long").alias("bytes"))


def windowed(stream: DataFrame, time: str, width: str, delay: str, key: str, value: str) -> DataFrame:
    """Count and sum per key in tumbling windows; late rows beyond the delay are left out."""
    rows = stream.withWatermark(time, delay).groupBy(F.window(time, width).alias("w"), key)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")


def run_available(stream: DataFrame, mode: str = "append", folder: str | None = None) -> DataFrame:
    """Runs a stream over what is there now and gives its result as a table of Parquet files.

    ``folder`` holds the stream's state and rows: a later run with the same folder goes on where the
    last one ended and reads new files only. Without one a new folder in the shared one is taken.
    Appended rows are written once; a complete result replaces the one before it. Where there was nothing to read the table is empty.
    """
    spark = stream.sparkSession
    folder = (folder or f"{shared_folder(spark)}/lexiloom/stream-{uuid.uuid4().hex}").rstrip("/")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").option("path", f"{folder}/rows").start().awaitTermination()
    else:
        writer.foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(f"{folder}/rows")).start().awaitTermination()
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/rows")
        if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):  # no batch ran
            spark.createDataFrame([], stream.schema).write.parquet(f"{folder}/rows")
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def within_rate(rows: DataFrame, count: Callable[[str], int], per_minute: float, text: str = "text", tries: int = 4, out: str = "n_tokens") -> DataFrame:
    """Adds what an outside service counts for each text: at most ``per_minute`` calls by all tasks together.

    Each of the tasks that can run at once has an equal share of the rate and spaces its calls so. A
    call that fails is made again with growing pauses; after ``tries`` the count is null, so failures
    are rows and never end the run.
    """
    at_once = rows.sparkSession.sparkContext.defaultParallelism
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.LongType())])
    gap = 60.0 * at_once / per_minute

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ready = time.monotonic()
        for batch in batches:
            counts: list[int | None] = []
            for value in batch[text]:
                got = None
                for again in range(tries):
                    time.sleep(max(0.0, ready - time.monotonic()))
                    ready = max(ready, time.monotonic()) + gap
                    try:
                        got = int(count(value))
                        break
                    except Exception:  # whatever the service raises
                        ready += gap * 2**again
                counts.append(got)
            yield batch.assign(**{out: pd.array(counts, dtype="Int64")})

    return rows.mapInPandas(run, schema)


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An append-only log of JSON lines; a line that was cut off while it was written is left out."""
    rows = spark.read.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "__bad").schema(f"{schema}, __bad string").json(path)
    return rows.filter("__bad is null").drop("__bad")


def windows_by_step(metrics: DataFrame, step: str, value: str, width: int) -> DataFrame:
    """Mean of a metric in each window of ``width`` steps beside the running mean of all steps up to its end."""
    rows = metrics.groupBy(F.floor(F.col(step) / width).alias("window")).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    upto = prefix_sums(rows, ["window"], {"__s": "s", "__n": "n"})
    return upto.select("window", (F.col("s") / F.col("n")).alias("mean"), (F.col("__s") / F.col("__n")).alias("running"))
