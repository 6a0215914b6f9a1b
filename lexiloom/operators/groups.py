"""Parallel groups in long form: group_id, lang, text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.text import alpha3, short_code
from lexiloom.operators.frames import numbered_within


def parallel(df: DataFrame, order: str, lang: str = "lang", text: str = "text") -> DataFrame:
    """Makes groups of the k-th rows of every language; ``order`` tells a language's rows apart."""
    rows = numbered_within(df.select(order, lang, text), lang, order, "group_id")
    return rows.select("group_id", F.col(lang).alias("lang"), F.col(text).alias("text"))


def intersected(groups: DataFrame, langs: list[str]) -> DataFrame:
    """Groups that have all of ``langs``, only with these; a language's last row in a group counts. No N-way join."""
    rows = groups.filter(F.col("lang").isin(langs))
    full = rows.groupBy("group_id").agg(F.countDistinct("lang").alias("n")).filter(F.col("n") == len(set(langs))).select("group_id")
    return rows.join(full, "group_id", "left_semi")


def wide(groups: DataFrame) -> DataFrame:
    """One row per group with a map from language to text."""
    return groups.groupBy("group_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("lang", "text")))).alias("texts"))


def with_anchor(rows: DataFrame, anchor: str, values: list[str], group: str = "group_id", lang: str = "lang") -> DataFrame:
    """Adds the anchor language's values of each group as ``anchor_<value>``: the exact code, else the first with this short code."""
    rank = F.when(F.col(lang) == anchor, 0).when(short_code(F.col(lang)) == anchor, 1)
    best = rows.withColumn("__r", rank).filter("__r is not null").groupBy(group).agg(F.min(F.struct("__r", lang, *values)).alias("__a"))
    return rows.join(best, group, "left").select(*[rows[c] for c in rows.columns], *[F.col(f"__a.{v}").alias(f"anchor_{v}") for v in values])


def canonical_pairs(pairs: DataFrame, a: str, b: str, stem: str) -> DataFrame:
    """One stem for each unordered pair of languages, the alphabetically first."""
    return pairs.groupBy(F.least(a, b).alias("lang_a"), F.greatest(a, b).alias("lang_b")).agg(F.min(stem).alias("stem"))


def language_overlap(train: DataFrame, dev: DataFrame, lang: str = "lang") -> DataFrame:
    """Languages of both sides and where they are: both, train or dev."""
    t, d = train.select(lang).distinct().withColumn("t", F.lit(1)), dev.select(lang).distinct().withColumn("d", F.lit(1))
    place: Column = F.when(F.col("t").isNull(), "dev").when(F.col("d").isNull(), "train").otherwise("both")
    return t.join(d, lang, "full").select(lang, place.alias("place"))


def pooled_by_language(rows: DataFrame, lang: str = "lang") -> DataFrame:
    """Rows under their normalised language, so that differently spelt codes of one language are pooled; ``raw`` keeps the code."""
    return rows.withColumn("raw", F.col(lang)).withColumn(lang, alpha3(F.col("raw")))


def raw_codes(pooled: DataFrame, lang: str = "lang") -> DataFrame:
    """The codes that each normalised language was made of, with the number of rows."""
    codes = F.array_join(F.array_sort(F.collect_set("raw")), ",")
    return pooled.groupBy(lang).agg(codes.alias("codes"), F.count(F.lit(1)).alias("n"))


def merged_sources(first: DataFrame, second: DataFrame, overrides: DataFrame, key: str = "code", value: str = "sources") -> DataFrame:
    """Sources by code: those of both tables one after another, or an override's instead."""
    a, b, c = (df.select(key, F.col(value).alias(n)) for df, n in ((first, "a"), (second, "b"), (overrides, "c")))
    joined = a.join(b, key, "full").join(c, key, "full")
    return joined.select(key, F.coalesce("c", F.when(F.coalesce("a", "b").isNotNull(), F.concat_ws(",", "a", "b"))).alias(value))


def canonical_files(entries: DataFrame, lang: str = "lang", file: str = "file", order: str = "first_seen") -> DataFrame:
    """Each language's file with the most entries (the first seen of equals), its entries, and the number of other files."""
    sizes = entries.groupBy(lang, file).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("seen"))
    best = F.max(F.struct("n", (-F.col("seen")).alias("s"), file))
    return sizes.groupBy(lang).agg(best.alias("b"), (F.count(F.lit(1)) - 1).alias("alternatives")).select(lang, F.col(f"b.{file}").alias(file), F.col("b.n").alias("entries"), "alternatives")


def known_sizes(results: DataFrame, sizes: DataFrame, key: str = "tokenizer", size: str = "vocab_size") -> DataFrame:
    """Results of those tokenizers whose vocabulary size is known."""
    return results.join(sizes.filter(F.col(size).isNotNull()), key)


def unresolved(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.join(right, key, "left_anti")


def cascade(names: DataFrame, name: str, candidates: Column, taxonomy: DataFrame, aliases: DataFrame) -> DataFrame:
    """Level of each name: that of its alias, else of its first candidate in the taxonomy, else null."""
    looked = names.select(name, F.posexplode(candidates).alias("pos", "candidate"))
    first = looked.join(taxonomy.withColumnRenamed("name", "candidate"), "candidate").groupBy(name).agg(F.min(F.struct("pos", "level")).alias("hit"))
    manual = aliases.withColumnRenamed("alias", name).join(taxonomy.withColumnRenamed("name", "target"), "target").select(name, F.col("level").alias("manual"))
    return names.join(first, name, "left").join(manual, name, "left").select(name, F.coalesce("manual", "hit.level").alias("level"))
