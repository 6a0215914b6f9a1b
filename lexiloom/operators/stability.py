"""How far a tokenizer's spans change when bytes of a text are deleted."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def perturbed(df: DataFrame, key: str, text: str = "text", fraction: float = 0.1, out: str = "perturbed") -> DataFrame:
    """Deletes a tenth of the bytes (at least one, never all) at places that a hash of key and place chooses."""
    data = F.encode(F.col(text), "UTF-8")
    n = F.octet_length(text)
    gone = F.greatest(F.lit(1), F.least(F.round(n * fraction).cast("int"), n - 1))
    marks = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.md5(F.concat_ws(":", F.col(key).cast("string"), i.cast("string"))).alias("m"), i.alias("i")))
    kept = F.array_sort(F.transform(F.slice(F.array_sort(marks), gone + 1, n), lambda x: x["i"]))
    digits = F.hex(data)
    rest = F.unhex(F.array_join(F.transform(kept, lambda i: F.substring(digits, 2 * i - 1, F.lit(2))), ""))
    return df.withColumn(out, F.when(n <= 1, data).otherwise(rest))


def distance(a: list[bytes], b: list[bytes]) -> int:
    """Edit distance of two span sequences."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    return row[-1]


def stability(a: list[bytes], b: list[bytes]) -> float:
    return 1.0 if not a and not b else 1 - distance(a, b) / max(len(a), len(b))


def by_lang(df: DataFrame, key: str, spans: Callable[[bytes], list[bytes]], samples: int = 15, lang: str = "lang", text: str = "text") -> DataFrame:
    """Mean stability of up to ``samples`` texts of each language, drawn by a hash (a sampling operator)."""
    mark = F.md5(F.col(key).cast("string"))
    drawn = df.withColumn("__i", F.row_number().over(Window.partitionBy(lang).orderBy(mark, key))).filter(F.col("__i") <= samples)
    rows = perturbed(drawn, key, text).select(lang, F.encode(F.col(text), "UTF-8").alias("a"), F.col("perturbed").alias("b"))

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            yield pd.Series([stability(spans(bytes(x)), spans(bytes(y))) for x, y in zip(a, b, strict=True)])

    return rows.withColumn("s", score("a", "b")).groupBy(lang).agg(F.avg("s").alias("stability"), F.count(F.lit(1)).alias("n"))
