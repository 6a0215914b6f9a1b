"""Tables across tokenizers: merging, leaderboards, charts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def merged(results: DataFrame, key: str = "tokenizer", order: str = "file_idx") -> DataFrame:
    """The last file's row of each key."""
    last = results.groupBy(key).agg(F.max(order).alias("__last"))
    return results.join(last, key).filter(F.col(order) == F.col("__last")).drop("__last")


def still_failed(failed: DataFrame, results: DataFrame, key: str = "tokenizer") -> DataFrame:
    """Failures of keys that succeeded in no file."""
    return failed.join(results.select(key).distinct(), key, "left_anti")


def require_keys(results: DataFrame, wanted: DataFrame, key: str = "tokenizer") -> DataFrame:
    """Results of the wanted keys; an error names those that are missing."""
    missing = [r[0] for r in wanted.join(results, key, "left_anti").select(key).limit(20).collect()]
    if missing:
        raise ValueError(f"no results for {', '.join(map(str, missing))}")
    return results.join(wanted, key, "left_semi")


def require_value(results: DataFrame, column: str, key: str = "tokenizer") -> DataFrame:
    bad = results.filter(F.col(column).isNull()).select(key).limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0][0]} has no {column}")
    return results


def backfilled(results: DataFrame, column: str, value: Column) -> DataFrame:
    return results.withColumn(column, F.coalesce(F.col(column), value))


def leaderboard(results: DataFrame, value: str = "spread", key: str = "tokenizer") -> DataFrame:
    """Adds ``idx``, the place by value from 0 (ties by name)."""
    return results.withColumn("idx", F.row_number().over(Window.orderBy(value, key)) - 1)


def family_layout(results: DataFrame, family: str, value: str, key: str = "tokenizer", gap: int = 1) -> DataFrame:
    """Chart positions with families side by side, a gap between them."""
    inner = F.row_number().over(Window.partitionBy(family).orderBy(value, key)) - 1
    sizes = results.groupBy(family).agg(F.count(F.lit(1)).alias("__n"), F.min(value).alias("__best"))
    before = Window.orderBy("__best", family).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(family, F.coalesce(F.sum(F.col("__n") + gap).over(before), F.lit(0)).alias("__start"))
    return results.withColumn("__i", inner).join(starts, family).withColumn("position", F.col("__start") + F.col("__i")).drop("__i", "__start")


@dataclass(frozen=True)
class FamilyRule:
    """A family and the names that belong to it: listed ones, beginnings, or parts of the lower-cased name."""

    family: str
    names: tuple[str, ...] = ()
    starts: tuple[str, ...] = ()
    parts: tuple[str, ...] = ()


#: Families of tokenizers by their names' publishers, in the order in which they are tried.
FAMILY_RULES = (
    FamilyRule("OpenAI/tiktoken", starts=("tiktoken:", "openai")),
    FamilyRule("Anthropic", starts=("anthropic",), parts=("claude",)),
    FamilyRule("Chinese labs", starts=("Qwen", "deepseek", "moonshotai")),
    FamilyRule("Meta/Llama", names=("NousResearch/Llama-2-7b-hf",), starts=("meta-llama",)),
)


def family_of(name: Column, own: list[str] | None = None, encoders: list[str] | None = None) -> Column:
    """The family of a tokenizer by its name: own ones first, then the first rule that fits, then encoders, else Other."""
    out = F.when(name.isin(encoders or []), "Encoder-only").otherwise("Other")
    for rule in reversed(FAMILY_RULES):
        fits = name.isin(list(rule.names))
        for s in rule.starts:
            fits = fits | name.startswith(s)
        for p in rule.parts:
            fits = fits | F.lower(name).contains(p)
        out = F.when(fits, rule.family).otherwise(out)
    return F.when(name.isin(own or []), "This work").otherwise(out)


def short_name(name: Column) -> Column:
    """The last part of a path-like name, with a short prefix for tables of one library."""
    return F.replace(F.substring_index(name, "/", -1), F.lit("tiktoken:"), F.lit("tk:"))


def family_means(parities: DataFrame, family: Column, value: str = "parity", keys: tuple[str, ...] = ("lang",)) -> DataFrame:
    """Mean per family and key; a family without tokenizers there has no row."""
    return parities.withColumn("family", family).groupBy("family", *keys).agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"))


def scoped_leaderboard(results: DataFrame, ours: list[str], value: str = "spread", key: str = "tokenizer") -> DataFrame:
    """A leaderboard of two groups, ours and the others, ranked anew."""
    return leaderboard(results.withColumn("family", F.when(F.col(key).isin(ours), "This work").otherwise("Other")), value, key)


def without_value(results: DataFrame, column: str, key: str = "tokenizer") -> DataFrame:
    """The keys whose entry lacks a value."""
    return results.filter(F.col(column).isNull()).select(key)


def same_shape(tables: list[DataFrame]) -> DataFrame:
    """Result tables as one, numbered by their place (``file_idx``); tables of different columns or types are an error."""
    first = dict(tables[0].dtypes)
    for i, t in enumerate(tables):
        if dict(t.dtypes) != first:
            raise ValueError(f"table {i} has other columns than the first: {sorted(set(first.items()) ^ set(t.dtypes))}")
    out = None
    for i, t in enumerate(tables):
        part = t.select(*tables[0].columns, F.lit(i).alias("file_idx"))
        out = part if out is None else out.unionByName(part)
    return out


def vocabulary_sizes(spark: SparkSession, own: dict[str, int], hidden: list[str], load: dict[str, Callable[[], int]]) -> DataFrame:
    """Rows (tokenizer, vocab_size, source, error): declared, not published (null), or loaded; a failed load is a row with its error."""
    rows: list[tuple] = [(k, n, "declared", None) for k, n in own.items()] + [(k, None, "proprietary", None) for k in hidden]
    for name, get in load.items():
        try:
            rows.append((name, int(get()), "loaded", None))
        except Exception as error:  # whatever a loader raises
            rows.append((name, None, "loaded", str(error)))
    return spark.createDataFrame(rows, "tokenizer string, vocab_size long, source string, error string")


def heat_cells(parities: DataFrame, n: int, lang: str = "lang", value: str = "parity") -> DataFrame:
    """Cells of the n languages whose greatest parity is highest, with a colour bucket of 40."""
    worst = parities.groupBy(lang).agg(F.max(value).alias("__m")).orderBy(F.col("__m").desc(), lang).limit(n).select(lang)
    rows = parities.join(worst, lang, "left_semi")
    top = Window.partitionBy()
    span = F.sqrt(F.greatest(F.max(value).over(top) - 1, F.lit(0.0)))
    bucket = F.when(span > 0, F.least(F.lit(39), F.floor(F.sqrt(F.greatest(F.col(value) - 1, F.lit(0.0))) / span * 40))).otherwise(0)
    return rows.withColumn("bucket", bucket.cast("long"))


def resource_levels(parities: DataFrame, levels: DataFrame, value: str = "parity") -> DataFrame:
    """Mean per tokenizer and level, and per level over all tokenizers (null tokenizer)."""
    rows = parities.join(levels, "lang")
    return rows.groupingSets([[F.col("tokenizer"), F.col("level")], [F.col("level")]], F.col("tokenizer"), F.col("level")).agg(F.avg(value).alias("mean_parity"), F.count(F.lit(1)).alias("n"))


def api_cost(parities: DataFrame, base_fertility: Column, words: float, price: float) -> DataFrame:
    """Cost of a text of so many English words in each language at a price per million tokens."""
    return parities.withColumn("cost", base_fertility * words * F.col("parity") * price / 1e6)


def progress(tasks: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Per cent of tasks that have a count; the rest is what a resumed run would do."""
    marked = tasks.select(*keys).join(done.select(*keys).distinct().withColumn("__d", F.lit(1)), keys, "left")
    return marked.agg((100.0 * F.count("__d") / F.count(F.lit(1))).alias("percent"))


def remaining(tasks: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return tasks.join(done, keys, "left_anti")


def as_metrics(df: DataFrame, key: str, prefix: str, values: list[str]) -> DataFrame:
    """Long form (metric, value) with names such as prefix/value/key."""
    rows = df.select(key, *[F.col(v).cast("double").alias(v) for v in values]).unpivot([key], values, "__v", "value")
    return rows.select(F.concat_ws("/", F.lit(prefix), "__v", key).alias("metric"), "value")
