"""Tokenizer metrics over (group_id, lang, spans)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions.text import word_count
from lexiloom.operators.frames import prefix_sums
from lexiloom.operators.groups import with_anchor


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def counts(rows: DataFrame, tokens: Column, text: str = "text") -> DataFrame:
    """Adds bytes, tokens and words of each text."""
    return rows.withColumns({"n_bytes": F.octet_length(text).cast("long"), "n_tokens": tokens.cast("long"), "n_words": word_count(F.col(text)).cast("long")})


def by_lang(counted: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Mean compression of the texts, fertility of all their words, totals."""
    return counted.groupBy(*(keys or ["lang"])).agg(
        F.avg(ratio(F.col("n_bytes"), F.col("n_tokens"))).alias("compression"),
        ratio(F.sum("n_tokens"), F.sum("n_words")).alias("fertility"),
        F.sum("n_tokens").alias("tokens"),
        F.count(F.lit(1)).alias("texts"),
    )


def frequencies(rows: DataFrame, spans: Column, keys: list[str] | None = None) -> DataFrame:
    """Rows (lang, span, cnt)."""
    by = keys or ["lang"]
    return rows.select(*by, F.explode(spans).alias("span")).groupBy(*by, "span").agg(F.count(F.lit(1)).alias("cnt"))


def renyi(freq: DataFrame, alpha: float = 2.5, keys: list[str] | None = None, count: str = "cnt") -> DataFrame:
    """Rényi efficiency of the counts per key: entropy of order alpha over the log of the number of types."""
    by = keys or ["lang"]
    total = freq.groupBy(*by).agg(F.sum(count).alias("total"), F.count(F.lit(1)).alias("types"))
    p = F.col(count) / F.col("total")
    parts = freq.join(total, by).filter((F.col(count) > 0) & (F.col("total") > 0))
    if abs(alpha - 1) < 1e-9:
        entropy = -F.sum(p * F.log(p))
    else:
        entropy = F.log(F.sum(F.pow(p, F.lit(alpha)))) / (1 - alpha)
    h = parts.groupBy(*by).agg(entropy.alias("entropy"))
    return total.join(h, by, "left").select(*by, F.when((F.col("types") > 1) & (F.col("total") > 0), F.col("entropy") / F.log("types")).otherwise(0.0).alias("renyi"))


def gini(df: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """Gini coefficient per key, or over all rows; ranks come from counts of distinct values and running sums over ranges of them."""
    by = keys or []
    tally = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("m"))
    if by:
        rows = tally.withColumn("upto", F.sum("m").over(Window.partitionBy(*by).orderBy(value)))
    else:
        rows = prefix_sums(tally, [value], {"upto": "m"})
    # the m equal values have ranks upto-m+1 to upto
    ranks = F.col(value) * (F.col("m") * (2 * F.col("upto") - F.col("m") + 1) / 2)
    sums = rows.groupBy(*by).agg(F.sum(ranks).alias("r"), F.sum(F.col(value) * F.col("m")).alias("s"), F.sum("m").alias("n"))
    return sums.select(*by, F.when(F.col("s") > 0, (2 * F.col("r") - (F.col("n") + 1) * F.col("s")) / (F.col("n") * F.col("s"))).otherwise(0.0).alias("gini"))


def parity(counted: DataFrame, anchor: str, measure: str = "n_tokens") -> DataFrame:
    """Total of a measure over its anchor's in groups that have both; 1 where no group has (``paired`` false)."""
    both = with_anchor(counted, anchor, [measure]).filter(F.col(f"anchor_{measure}").isNotNull())
    got = both.groupBy("lang").agg((F.sum(measure) / F.sum(f"anchor_{measure}")).alias("parity"))
    langs = counted.select("lang").distinct()
    return langs.join(got, "lang", "left").select("lang", F.coalesce("parity", F.lit(1.0)).alias("parity"), F.col("parity").isNotNull().alias("paired"))


def anchor_invariant(parities: DataFrame, value: str = "parity") -> DataFrame:
    """Parities over their geometric mean; positives only."""
    rows = parities.filter(F.col(value) > 0)
    mean = rows.agg(F.exp(F.avg(F.log(value))).alias("gm"))
    return rows.crossJoin(F.broadcast(mean)).select("lang", (F.col(value) / F.col("gm")).alias("relative"))  # one row


def spread(parities: DataFrame, value: str = "parity") -> DataFrame:
    """Largest over least positive parity; 1 without any."""
    rows = parities.filter(F.col(value) > 0)
    return rows.agg(F.coalesce(F.max(value) / F.min(value), F.lit(1.0)).alias("spread"))


def reanchored(relative: DataFrame) -> DataFrame:
    """For each language as anchor, the mean of the others' relative parity over its own."""
    total = relative.agg(F.sum("relative").alias("total"), F.count(F.lit(1)).alias("n"))
    rows = relative.crossJoin(F.broadcast(total))  # one row
    return rows.select("lang", F.when(F.col("n") > 1, (F.col("total") - F.col("relative")) / (F.col("n") - 1) / F.col("relative")).alias("mean_parity"))


def span_length_histogram(freq: DataFrame) -> DataFrame:
    return freq.groupBy(F.octet_length("span").cast("long").alias("span_length")).agg(F.sum("cnt").alias("cnt"))


def span_report(freq: DataFrame, short: float = 1.2, long: float = 40.0) -> DataFrame:
    """Average span length, share of spans seen once, and whether the lengths have collapsed."""
    size = F.octet_length("span")
    got = freq.agg((F.sum(size * F.col("cnt")) / F.sum("cnt")).alias("avg_length"), F.avg((F.col("cnt") == 1).cast("double")).alias("singletons"))
    return got.withColumn("too_short", F.col("avg_length") < short).withColumn("too_long", F.col("avg_length") > long)


def mixed_anchor(counted: DataFrame, manifest: DataFrame, measure: str = "n_tokens") -> DataFrame:
    """Parity per anchor of the manifest (lang, anchor); a group takes part under every anchor that it holds."""
    anchors = counted.join(manifest.select(F.col("anchor").alias("lang")).distinct(), "lang").select("group_id", F.col("lang").alias("anchor"), F.col(measure).alias("base"))
    pairs = counted.join(manifest, "lang").join(anchors, ["group_id", "anchor"])
    return pairs.groupBy("anchor", "lang").agg((F.sum(measure) / F.sum("base")).alias("parity"))


def require_anchors(groups: DataFrame, anchors: list[str]) -> DataFrame:
    """The groups themselves; an error if one of them has none of the anchor languages."""
    bare = groups.groupBy("group_id").agg(F.max(F.col("lang").isin(anchors).cast("int")).alias("has")).filter("has = 0").limit(1).collect()
    if bare:
        raise ValueError(f"group {bare[0]['group_id']} has none of the anchors {', '.join(anchors)}")
    return groups


def panel(counted: DataFrame, manifest: DataFrame, freq: DataFrame | None = None) -> DataFrame:
    """Per language what compares across anchors: compression and fertility, and with ``freq`` the Rényi efficiency.

    Tokenizers that only count tokens have no frequencies; their ``renyi`` is null, not 0.
    """
    langs = manifest.select("lang").union(manifest.select(F.col("anchor").alias("lang"))).distinct()
    per = by_lang(counted.join(langs, "lang", "left_semi")).select("lang", "compression", "fertility")
    return per.join(renyi(freq), "lang", "left") if freq is not None else per.withColumn("renyi", F.lit(None).cast("double"))


def morphology_spread(per_lang: DataFrame) -> DataFrame:
    """Greatest over least positive fertility and compression of a panel; 1 without any."""
    over = lambda c: F.coalesce(F.max(F.when(F.col(c) > 0, F.col(c))) / F.min(F.when(F.col(c) > 0, F.col(c))), F.lit(1.0))
    return per_lang.agg(over("fertility").alias("fertility_spread"), over("compression").alias("compression_spread"))


def counted_or_failed(calls: DataFrame, count: str = "n_tokens") -> tuple[DataFrame, DataFrame]:
    """Calls with a count, and per language the number of calls and of those that failed (null count)."""
    tally = calls.groupBy("lang").agg(F.count(F.lit(1)).alias("calls"), F.sum(F.col(count).isNull().cast("long")).alias("failed"))
    return calls.filter(F.col(count).isNotNull()), tally


def target_rate(sequences: DataFrame, n_tokens: Column, size: Column) -> DataFrame:
    """Mean bytes over mean tokens of a sample: the rate a plain vocabulary reaches."""
    return sequences.agg(ratio(F.avg(size), F.avg(n_tokens)).alias("target_rate"))


def lang_targets(parities: DataFrame, anchor_rate: float, floor: float, ceiling: float) -> DataFrame:
    """Per language the anchor's rate times its byte parity, kept between two limits."""
    return parities.select("lang", F.greatest(F.lit(floor), F.least(F.lit(ceiling), anchor_rate * F.col("parity"))).alias("target"))


def mean_loss(losses: DataFrame, value: str = "loss") -> DataFrame:
    """Mean loss of a fixed set of batches; not a number without any."""
    return losses.agg(F.coalesce(F.avg(value), F.lit(float("nan"))).alias("loss"))


def training_budget(params: Column, tokens_per_param: Column) -> dict[str, Column]:
    """Planned tokens and floating-point operations (6 per parameter and token) of a model."""
    tokens = params * tokens_per_param
    return {"tokens": tokens, "flops": 6 * params * tokens}


def rate_band(counted: DataFrame, anchor: str, alpha: float = 0.25, margin: float = 1.0, floor: float = 0.05, ceiling: float = 0.9, beta_floor: float = 0.02) -> DataFrame:
    """Per language an upper rate from its byte parity and a lower one from how its lengths vary."""
    lengths = counted.groupBy("lang").agg((F.stddev_pop("n_bytes") / F.avg("n_bytes")).alias("cv"))
    rows = parity(counted, anchor, "n_bytes").join(lengths, "lang")
    upper = F.greatest(F.lit(floor), F.least(F.lit(ceiling), alpha / F.col("parity")))
    rows = rows.withColumn("alpha", upper)
    lower = F.least(F.col("alpha"), F.greatest(F.lit(beta_floor), F.col("alpha") - margin * F.col("alpha") * F.col("cv")))
    return rows.withColumn("beta", lower).select("lang", "alpha", "beta")


def rate_factor(step: Column, warmup: int, total: int, shape: str = "cosine") -> Column:
    """Learning-rate factor of a step: linear warm-up from 0, then constant, linear or cosine decay."""
    done = F.least(F.lit(1.0), (step - warmup) / max(1, total - warmup))
    after = {"constant": F.lit(1.0), "linear": 1 - done, "cosine": 0.5 * (1 + F.cos(F.pi() * done))}[shape]
    return F.when(step < warmup, step / max(1, warmup)).otherwise(after)


def extremes(values: DataFrame, value: str, lang: str = "lang") -> DataFrame:
    """Population variance, and the languages with the least and the greatest value."""
    first = lambda f, sign: f(F.struct(F.col(value), F.col(lang)))
    got = values.agg(F.var_pop(value).alias("variance"), first(F.min, 1).alias("lo"), first(F.max, -1).alias("hi"))
    return got.select("variance", F.col(f"lo.{lang}").alias("min_lang"), F.col(f"hi.{lang}").alias("max_lang"))
