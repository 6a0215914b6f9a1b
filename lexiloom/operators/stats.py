"""Statistics that compare groups: quantiles, ranks, correlations, box plots, z-scores."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.operators.frames import prefix_sums


def average_rank(value: str, keys: list[str]) -> Column:
    """Rank with ties sharing the mean of their places; nulls are not expected."""
    by = Window.partitionBy(*keys)
    return F.rank().over(by.orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, value)) - 1) / 2.0


def tied_ranks(df: DataFrame, value: str, name: str) -> DataFrame:
    """Average ranks over all rows from counts of distinct values, summed up over ranges of values; no task sees them all."""
    tally = df.groupBy(value).agg(F.count(F.lit(1)).alias("__m"))
    ranks = prefix_sums(tally, [value], {"__upto": "__m"})
    return df.join(ranks.select(value, (F.col("__upto") - (F.col("__m") - 1) / 2.0).alias(name)), value)


def pearson(df: DataFrame, x: str, y: str, keys: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(keys or [])).agg(F.corr(x, y).alias("r"), F.pow(F.corr(x, y), F.lit(2)).alias("r2"), F.count(F.lit(1)).alias("n"))


def spearman(df: DataFrame, x: str, y: str, keys: list[str] | None = None) -> DataFrame:
    by = keys or []
    if by:
        ranked = df.withColumns({"__x": average_rank(x, by), "__y": average_rank(y, by)})
    else:
        ranked = tied_ranks(tied_ranks(df, x, "__x"), y, "__y")
    return ranked.groupBy(*by).agg(F.corr("__x", "__y").alias("rho"), F.count(F.lit(1)).alias("n"))


def kruskal(df: DataFrame, value: str, group: str) -> DataFrame:
    """Kruskal-Wallis H with the correction for ties."""
    ranked = tied_ranks(df, value, "__r")
    per = ranked.groupBy(group).agg(F.sum("__r").alias("s"), F.count(F.lit(1)).alias("m"))
    total = per.agg(F.sum(F.col("s") * F.col("s") / F.col("m")).alias("q"), F.sum("m").alias("n"), F.count(F.lit(1)).alias("groups"))
    ties = df.groupBy(value).agg(F.count(F.lit(1)).cast("double").alias("t")).agg(F.sum(F.pow("t", F.lit(3)) - F.col("t")).alias("ties"))
    n = F.col("n").cast("double")
    h = 12 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)
    return total.crossJoin(ties).select((h / (1 - F.col("ties") / (n * n * n - n))).alias("h"), "groups", "n")


def exclusive_quartile(df: DataFrame, value: str, k: int, keys: list[str]) -> DataFrame:
    """The k-th quartile by the exclusive method (place k(n+1)/4); groups of one row have none."""
    w = Window.partitionBy(*keys)
    rows = df.withColumns({"__i": F.row_number().over(w.orderBy(value)), "__n": F.count(F.lit(1)).over(w)}).filter("__n > 1")
    m = F.col("__n") + 1
    j = F.greatest(F.lit(1), F.least(F.floor(k * m / 4), F.col("__n") - 1))
    d = k * m - 4 * j
    part = F.when(F.col("__i") == j, F.col(value) * (4 - d)).when(F.col("__i") == j + 1, F.col(value) * d).otherwise(0.0)
    return rows.groupBy(*keys).agg((F.sum(part) / 4).alias("quartile"))


def worst_quartile(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Adds ``worst``: at or above the third exclusive quartile of its group."""
    return df.join(exclusive_quartile(df, value, 3, keys), keys).withColumn("worst", F.col(value) >= F.col("quartile"))


def penalised(df: DataFrame, value: str, keys: list[str], item: str) -> DataFrame:
    """How often an item is in a group's worst quartile; 0 is kept."""
    marked = worst_quartile(df, value, keys).groupBy(item).agg(F.sum(F.col("worst").cast("long")).alias("penalised"))
    return df.select(item).distinct().join(marked, item, "left").select(item, F.coalesce("penalised", F.lit(0)).alias("penalised"))


def grouped_mean(df: DataFrame, value: str, by: str, at_least: int = 1) -> DataFrame:
    return df.groupBy(by).agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= at_least)


def zscores(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Standard scores in groups of two and more whose values differ."""
    stats = df.groupBy(*keys).agg(F.avg(value).alias("__mean"), F.stddev_pop(value).alias("__std"), F.count(F.lit(1)).alias("__n")).filter("__n >= 2 and __std > 0")
    return df.join(stats, keys).withColumn("z", (F.col(value) - F.col("__mean")) / F.col("__std")).drop("__mean", "__std", "__n")


def tukey(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Quartiles (linear), whiskers at the last values within 1.5 of the range between quartiles, number of outliers."""
    q = df.groupBy(*keys).agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    rows = df.join(q, keys).select(*keys, F.col(value).alias("v"), F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    low, high = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")), F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col("v").between(low, high)
    return rows.groupBy(*keys, "q1", "median", "q3").agg(F.min(F.when(inside, F.col("v"))).alias("low"), F.max(F.when(inside, F.col("v"))).alias("high"), F.sum((~inside).cast("long")).alias("outliers"))


def quadrants(df: DataFrame, x: str, y: str) -> DataFrame:
    """Adds the side of the medians on which a row lies, such as high-low."""
    m = df.agg(F.percentile(x, F.lit(0.5)).alias("mx"), F.percentile(y, F.lit(0.5)).alias("my"))
    side = lambda v, mid: F.when(F.col(v) > F.col(mid), "high").otherwise("low")
    return df.crossJoin(F.broadcast(m)).withColumn("quadrant", F.concat_ws("-", side(x, "mx"), side(y, "my"))).drop("mx", "my")  # one row


def outlier_lists(df: DataFrame, name: str, x: str, y: str, top: int = 5) -> DataFrame:
    """The first rows of two quadrants, with their place: high-high by falling values, low-low by rising ones."""
    sided = quadrants(df.select(name, x, y), x, y)
    lists = []
    for quadrant, order in (("high-high", [F.col(x).desc(), F.col(y).desc(), F.col(name)]), ("low-low", [F.col(x), F.col(y), F.col(name)])):
        first = sided.filter(F.col("quadrant") == quadrant).orderBy(*order).limit(top)
        lists.append(first.withColumn("place", F.row_number().over(Window.orderBy(*order))))
    return lists[0].unionByName(lists[1])


def box_outliers(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """The rows beyond a box plot's fences."""
    q = df.groupBy(*keys).agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.75))).alias("__q"))
    reach = 1.5 * (F.col("__q")[1] - F.col("__q")[0])
    return df.join(q, keys).filter(~F.col(value).between(F.col("__q")[0] - reach, F.col("__q")[1] + reach)).drop("__q")


def anomalies(df: DataFrame, value: str, keys: list[str], name: str, top: int = 10) -> DataFrame:
    """The rows furthest below their group's mean, in standard deviations: the least ``top`` of all."""
    return zscores(df, value, keys).orderBy("z", name, *keys).limit(top)


def correlations_by(df: DataFrame, key: str, x: str, y: str, least: int = 2) -> DataFrame:
    """Spearman's rho of each key that has at least ``least`` different values of x, with its two-sided p."""
    enough = df.groupBy(key).agg(F.countDistinct(x).alias("__k")).filter(F.col("__k") >= least).select(key)
    got = spearman(df.join(enough, key, "left_semi"), x, y, [key])

    @F.pandas_udf("double")
    def p_of(rho: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([None if r is None or math.isnan(r) else correlation_p(float(r), int(k)) for r, k in zip(rho, n, strict=True)], dtype="float64")

    return got.withColumn("p", p_of("rho", "n"))


def sign_counts(correlations: DataFrame, level: float = 0.05) -> DataFrame:
    """How many correlations are significantly negative, positive, or neither."""
    c, sure = F.col, F.coalesce(F.col("p") < level, F.lit(False))
    one = lambda cond: F.coalesce(F.sum(cond.cast("long")), F.lit(0))
    return correlations.agg(one(sure & (c("rho") < 0)).alias("negative"), one(sure & (c("rho") > 0)).alias("positive"), one(~(sure & (c("rho") != 0))).alias("neither"))


def spread_range(results: DataFrame, value: str = "spread", size: str = "vocab_size") -> DataFrame:
    """Least and greatest spread, their factor, and the rank correlation with vocabulary size (null under three sizes)."""
    span = results.agg(F.min(value).alias("least"), F.max(value).alias("greatest")).withColumn("factor", F.col("greatest") / F.col("least"))
    rho = spearman(results.filter(F.col(size).isNotNull()), size, value)
    rho = rho.select(F.when(F.col("n") >= 3, F.col("rho")).alias("rho"), F.col("n").alias("sized"))
    size_ = F.abs("rho")
    label = F.when(size_ >= 0.7, "strong").when(size_ >= 0.4, "moderate").when(size_ >= 0.2, "weak").when(size_.isNotNull(), "negligible")
    return span.crossJoin(F.broadcast(rho)).withColumn("strength", label)  # one row each


def _beta_fraction(a: float, b: float, x: float) -> float:
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d or 1e-300)
    out = d
    for m in range(1, 300):
        for numerator in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + numerator * d) or 1e-300)
            c = (1 + numerator / c) or 1e-300
            out *= c * d
        if abs(c * d - 1) < 1e-12:
            break
    return out


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def correlation_p(r: float, n: int) -> float:
    """Two-sided p of a correlation from Student's t with n - 2 degrees of freedom."""
    if n < 3:
        return float("nan")
    if abs(r) >= 1:
        return 0.0
    t2 = r * r * (n - 2) / (1 - r * r)
    return incomplete_beta((n - 2) / 2, 0.5, (n - 2) / (n - 2 + t2))


def chi2_p(x: float, k: int) -> float:
    """Upper tail of chi-squared: the regularised gamma function, by series or continued fraction."""
    a, x = k / 2, x / 2
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        for i in range(1, 1000):
            term *= x / (a + i)
            total += term
        return 1 - front * total
    b = x + 1 - a
    c, d = 1e300, 1 / b
    out = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / ((an * d + b) or 1e-300)
        c = (b + an / c) or 1e-300
        out *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return front * out


def strength(rho: float | None) -> str | None:
    if rho is None:
        return None
    size = abs(rho)
    return "strong" if size >= 0.7 else "moderate" if size >= 0.4 else "weak" if size >= 0.2 else "negligible"
