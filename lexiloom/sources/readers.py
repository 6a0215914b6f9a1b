"""Sources of parallel, bitext and monolingual text as long tables (group_id, source, lang, text)."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiloom.functions.text import ENTAILMENT_CHOICES, answer_prompt, cause_choices, cause_prompt, composed_words, entailment_prompt, file_stem, verse_id
from lexiloom.operators.frames import numbered
from lexiloom.operators.groups import intersected
from lexiloom.operators.ordering import interleave, within_budget

#: How the languages of a source belong together.
SOURCE_CLASS = {
    "jsonl_by_lang": "parallel",
    "parquet_by_lang": "parallel",
    "jsonl_groups": "bitext",
    "tsv_pairs": "bitext",
    "pair_rows": "bitext",
    "translations": "bitext",
    "csv_pairs": "bitext",
    "line_pairs": "bitext",
    "transcript": "bitext",
    "plain_text": "monolingual",
    "parquet_text": "monolingual",
    "arrow_text": "monolingual",
    "english_pairs": "bitext",
    "streamed_groups": "streamed",
    "jsonl_budget": "monolingual",
    "synthetic": "synthetic",
}
#: What ``all`` pools.
POOLED = ("jsonl_by_lang", "parquet_by_lang", "pair_rows")
READERS: dict[str, Callable[..., DataFrame]] = {}


def reader(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    READERS[f.__name__] = f
    return f


def _numbered(df: DataFrame, *order: str) -> DataFrame:
    return numbered(df, list(order), "group_id").withColumn("group_id", F.col("group_id") - 1)


def _present(df: DataFrame, *columns: str) -> DataFrame:
    """Rows whose columns all have text."""
    return df.filter(reduce(lambda a, b: a & b, [F.length(F.trim(c)) > 0 for c in columns]))


def _pair_groups(df: DataFrame, lang_a: str, a: str, lang_b: str, b: str) -> DataFrame:
    """A group of two rows from each row of a bitext."""
    both = F.array(F.struct(F.col(lang_a).alias("lang"), F.col(a).alias("text")), F.struct(F.col(lang_b).alias("lang"), F.col(b).alias("text")))
    return df.select("group_id", F.explode(both).alias("r")).select("group_id", "r.lang", "r.text")


def lines(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    """Rows (file, line, value); ``line`` orders a file's lines, which are read in splits."""
    read = spark.read.option("pathGlobFilter", glob) if glob else spark.read
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return read.text(path).select(F.col("_metadata.file_path").alias("file"), place.alias("line"), "value")


def _stem() -> Column:
    return F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(?:\.[^/.]+)?$", 1)


@reader
def jsonl_by_lang(spark: SparkSession, path: str) -> DataFrame:
    """A file per language with rows {id, text}; groups are ids, blank lines don't count."""
    rows = spark.read.option("pathGlobFilter", "*.jsonl").schema("id string, text string").json(path).select("id", _stem().alias("lang"), "text").filter("id is not null")
    ids = _numbered(rows.select("id").distinct(), "id")
    return rows.join(ids, "id").select("group_id", "lang", "text")


@reader
def jsonl_groups(spark: SparkSession, path: str) -> DataFrame:
    """Rows {lang: text} in JSON lines; blank and broken lines are left out."""
    rows = lines(spark, path, "*.jsonl").filter(F.trim("value") != "")
    parsed = rows.select("file", "line", F.from_json("value", "map<string,string>").alias("m")).filter("m is not null")
    return _numbered(parsed, "file", "line").select("group_id", F.explode("m").alias("lang", "text"))


@reader
def parquet_by_lang(spark: SparkSession, paths: Sequence[str] | str) -> DataFrame:
    """Parquet files per language with (uniq_id, src_text), several granularities one after another."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    parts = [spark.read.parquet(p).select("uniq_id", _stem().alias("lang"), F.col("src_text").alias("text"), F.lit(i).alias("part")) for i, p in enumerate(paths)]
    rows = reduce(DataFrame.unionByName, parts)
    ids = _numbered(rows.select("part", "uniq_id").distinct(), "part", "uniq_id")
    return rows.join(ids, ["part", "uniq_id"]).select("group_id", "lang", "text")


@reader
def tsv_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Lines of source language, target language, source, target; others, and those with an empty side, are left out."""
    cells = lines(spark, path).select("file", "line", F.split("value", "\t").alias("c")).filter(F.size("c") == 4)
    rows = cells.select("file", "line", *[F.col("c")[i].alias(n) for i, n in enumerate(("la", "lb", "a", "b"))])
    return _pair_groups(_numbered(_present(rows, "a", "b"), "file", "line"), "la", "a", "lb", "b")


@reader
def pair_rows(spark: SparkSession, path: str) -> DataFrame:
    """JSON rows sl, src, tl, trg; rows without one of the texts are left out."""
    rows = lines(spark, path).select("file", "line", F.from_json("value", "sl string, src string, tl string, trg string").alias("j")).select("file", "line", "j.*")
    return _pair_groups(_numbered(_present(rows, "src", "trg"), "file", "line"), "sl", "src", "tl", "trg")


@reader
def translations(spark: SparkSession, path: str, langs: Sequence[str]) -> DataFrame:
    """Parquet rows with a map ``translation``; rows need all of ``langs``."""
    rows = spark.read.parquet(path).select(F.monotonically_increasing_id().alias("group_id"), "translation")
    rows = rows.filter(reduce(lambda a, b: a & b, [F.length(F.col("translation")[k]) > 0 for k in langs]))
    return rows.select("group_id", F.explode("translation").alias("lang", "text")).filter(F.col("lang").isin(list(langs)))


@reader
def csv_pairs(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file whose header names two languages; rows with an empty side are left out."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    a, b = rows.columns[:2]
    keyed = _present(rows, a, b).select(F.monotonically_increasing_id().alias("group_id"), F.lit(a).alias("la"), F.col(a).alias("a"), F.lit(b).alias("lb"), F.col(b).alias("b"))
    return _pair_groups(keyed, "la", "a", "lb", "b")


@reader
def line_pairs(spark: SparkSession, path_a: str, path_b: str, lang_a: str, lang_b: str) -> DataFrame:
    """Two files whose lines belong together; different line counts are an error, empty sides are left out."""
    a, b = (_numbered(lines(spark, p).select("line", F.col("value").alias(n)), "line").drop("line") for p, n in ((path_a, "a"), (path_b, "b")))
    if a.count() != b.count():
        raise ValueError(f"{path_a} and {path_b} have different numbers of lines")
    rows = _present(a.join(b, "group_id"), "a", "b").select("group_id", F.lit(lang_a).alias("la"), "a", F.lit(lang_b).alias("lb"), "b")
    return _pair_groups(rows, "la", "a", "lb", "b")


@reader
def transcript(spark: SparkSession, path: str, tags: dict[str, str] | None = None) -> DataFrame:
    """Blocks of tagged lines between blank ones; ; starts a comment. A block counts if its tags have equally many lines."""
    tags = tags or {"M:": "M", "C:": "C"}
    rows = lines(spark, path).withColumn("value", F.trim("value"))
    block = F.sum((F.col("value") == "").cast("int")).over(Window.partitionBy("file").orderBy("line"))
    rows = rows.withColumn("block", block).filter("value != '' and not startswith(value, ';')")
    tag = reduce(lambda acc, t: acc.when(F.col("value").startswith(t[0]), t[1]), tags.items(), F.when(F.lit(False), ""))
    rows = rows.withColumn("lang", tag).filter("lang is not null").withColumn("text", F.trim(F.regexp_replace("value", "^[^:]*:", "")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda s: s["text"]), " ")
    per = rows.groupBy("file", "block", "lang").agg(joined.alias("text"), F.count(F.lit(1)).alias("n"))
    good = per.groupBy("file", "block").agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("lo"), F.max("n").alias("hi")).filter((F.col("k") == len(tags)) & (F.col("lo") == F.col("hi")))
    ids = _numbered(good.select("file", "block"), "file", "block")
    return per.join(ids, ["file", "block"]).select("group_id", "lang", "text")


@reader
def plain_text(spark: SparkSession, path: str, lang: str = "und") -> DataFrame:
    """A document per line of *.txt files, in the order of their names."""
    rows = lines(spark, path, "*.txt").withColumn("value", F.trim("value")).filter("value != ''")
    return _numbered(rows, "file", "line").select("group_id", F.lit(lang).alias("lang"), F.col("value").alias("text"))


@reader
def parquet_text(spark: SparkSession, path: str, lang: str = "lang", text: str = "text", order: str | None = None) -> DataFrame:
    """Parquet rows with a language and a text; empty texts are left out."""
    rows = spark.read.parquet(path).filter(F.length(text) > 0)
    ids = _numbered(rows, order) if order else rows.withColumn("group_id", F.monotonically_increasing_id())
    return ids.select("group_id", F.col(lang).alias("lang"), F.col(text).alias("text"))


@reader
def arrow_text(spark: SparkSession, path: str, lang: str = "und", text: str = "text") -> DataFrame:
    """Arrow IPC files, read on the executors from Spark's own listing of them."""
    from collections.abc import Iterator

    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                data = pa.BufferReader(content.as_buffer())
                try:
                    table = pa.ipc.open_file(data).read_all()
                except pa.ArrowInvalid:
                    table = pa.ipc.open_stream(pa.BufferReader(content.as_buffer())).read_all()
                for part in table.select([text]).rename_columns(["text"]).to_batches():
                    yield part.cast(pa.schema([("text", pa.string())]))

    rows = spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "text string")
    return rows.filter("length(text) > 0").select(F.monotonically_increasing_id().alias("group_id"), F.lit(lang).alias("lang"), "text")


@reader
def synthetic(spark: SparkSession, langs: Sequence[str], n: int, words: int = 12, seed: int = 0) -> DataFrame:
    """Invented parallel sentences: each language has its own alphabet, the same group has the same word lengths."""
    rows = spark.range(n).select(F.col("id").alias("group_id"), F.explode(F.array(*[F.struct(F.lit(k).alias("lang"), F.lit(i).alias("i")) for i, k in enumerate(langs)])).alias("l"))
    length = lambda w: F.pmod(F.xxhash64(F.lit(seed), F.col("group_id"), w), F.lit(6)).cast("int") + 2
    letter = lambda w, c: F.char(F.lit(97) + F.pmod(F.xxhash64(F.col("l.i"), F.col("group_id"), w, c), F.lit(8 + 2 * 4)).cast("int"))
    word = lambda w: F.array_join(F.transform(F.sequence(F.lit(1), length(w)), lambda c: letter(w, c)), "")
    return rows.select("group_id", F.col("l.lang").alias("lang"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(words)), word), " ").alias("text"))


@reader
def english_pairs(spark: SparkSession, path: str, config: str) -> DataFrame:
    """JSON rows english, non_english; the other language is in the config's name (en-xx or xx-en). Empty sides are left out."""
    other = next(k for k in config.split("-", 1) if k != "en")
    rows = lines(spark, path).select("file", "line", F.from_json("value", "english string, non_english string").alias("j")).select("file", "line", "j.*")
    rows = _numbered(_present(rows, "english", "non_english"), "file", "line").withColumns({"la": F.lit("en"), "lb": F.lit(other)})
    return _pair_groups(rows, "la", "english", "lb", "non_english")


@reader
def streamed_groups(spark: SparkSession, path: str) -> DataFrame:
    """JSON rows {lang, verses, text} of a translation each; verse lists are the groups' ids, empty texts are left out."""
    rows = lines(spark, path).select(F.from_json("value", "lang string, verses array<string>, text string").alias("j")).select("j.*")
    rows = _present(rows.select(verse_id(F.col("verses")).alias("id"), "lang", "text"), "text")
    ids = _numbered(rows.select("id").distinct(), "id")
    return rows.join(ids, "id").select("group_id", "lang", "text")


@reader
def jsonl_budget(spark: SparkSession, path: str, words: int, lang: str = "und", first: str = "clean", last: str = "noisy") -> DataFrame:
    """Gzipped JSON lines with a text, file by file until ``words`` words are read, the crossing row included.

    Files whose name has ``first`` come before those with ``last``; others are not read.
    """
    rows = lines(spark, path, "*.jsonl.gz").select("file", "line", F.from_json("value", "text string").alias("j")).select("file", "line", F.col("j.text").alias("text"))
    name = F.substring_index("file", "/", -1)
    rows = rows.withColumn("noisy", F.when(name.contains(first), 0).when(name.contains(last), 1)).filter("noisy is not null and text is not null")
    kept = within_budget(rows, words, F.size(composed_words(F.col("text"))), ["noisy", "file", "line"])
    return _numbered(kept, "noisy", "file", "line").select("group_id", F.lit(lang).alias("lang"), "text")


def source_class(source: str) -> str:
    """How the languages of a source belong together: parallel, bitext, monolingual, streamed or synthetic."""
    if source not in SOURCE_CLASS:
        raise ValueError(f"unknown source {source}; there are {', '.join(sorted(SOURCE_CLASS))}")
    return SOURCE_CLASS[source]


def joined_groups(rows: DataFrame, source: str, langs: Sequence[str], training: bool = True) -> DataFrame:
    """The groups to work on: of a parallel source those that have all languages for training, and all there are otherwise."""
    rows = rows.filter(F.col("lang").isin(list(langs)))
    return intersected(rows, list(langs)) if training and source_class(source) == "parallel" else rows


def discover(spark: SparkSession, path: str, suffix: str = "jsonl") -> DataFrame:
    """Rows (stem, file) of the files under a folder with a suffix; names only are read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{suffix}").load(path).select("path")
    return found.select(F.regexp_extract("path", rf"([^/]+)\.{suffix}$", 1).alias("stem"), F.col("path").alias("file"))


def read_groups(spark: SparkSession, source: str, langs: Sequence[str] | None = None, first_n: int | None = None, **options) -> DataFrame:
    """Rows (group_id, source, lang, text) of a named source; ``first_n`` groups of it at most."""
    if source not in READERS:
        raise ValueError(f"unknown source {source}; there are {', '.join(sorted(READERS))}")
    rows = READERS[source](spark, **({"langs": langs} if source in ("synthetic", "translations") else {}), **options)
    if langs and source not in ("synthetic", "translations"):
        rows = rows.filter(F.col("lang").isin(list(langs)))
    if first_n is not None:
        first = rows.select("group_id").distinct().orderBy("group_id").limit(first_n)
        rows = rows.join(first, "group_id", "left_semi")
    return rows.select("group_id", F.lit(source).alias("source"), "lang", "text")


def pool_sources(spark: SparkSession, sources: dict[str, dict], langs: Sequence[str] | None = None) -> DataFrame:
    """Several sources in one table; the synthetic one can't be pooled, nor can languages be restricted then.

    The single name ``all`` stands for the sources POOLED, whose options it maps by name.
    """
    if list(sources) == ["all"]:
        if missing := [k for k in POOLED if k not in sources["all"]]:
            raise ValueError(f"all needs options for {', '.join(missing)}")
        sources = {k: sources["all"][k] for k in POOLED}
    if len(sources) > 1 and "synthetic" in sources:
        raise ValueError("the synthetic source can't be pooled")
    if len(sources) > 1 and langs:
        raise ValueError("languages can only be chosen for one source")
    return reduce(DataFrame.unionByName, [read_groups(spark, name, langs, **options) for name, options in sources.items()])


def split_config(config: str) -> tuple[str, str]:
    """A config such as test/eng-deu or eng-deu as its split (test by default) and pair."""
    first, slash, rest = config.partition("/")
    return (first, rest) if slash else ("test", first)


def lang_pairs(text: str) -> list[tuple[str, str]]:
    """Pairs from src:tgt,src:tgt."""
    out = [tuple(p.strip().split(":")) for p in text.split(",") if p.strip()]
    if any(len(p) != 2 for p in out):
        raise ValueError(f"not a list of src:tgt pairs: {text}")
    return out


def restrict(langs: Sequence[str], valid: Sequence[str]) -> tuple[list[str], list[str]]:
    """Languages that a benchmark has, and those it lacks; an error if none is left."""
    kept, dropped = [k for k in langs if k in valid], [k for k in langs if k not in valid]
    if not kept:
        raise ValueError(f"none of {', '.join(langs)} is covered")
    return kept, dropped


def by_file_name(files: DataFrame, wanted: DataFrame, name: str = "name") -> tuple[DataFrame, DataFrame]:
    """Files found by their normalised name, and wanted names that none has."""
    f, w = files.withColumn("__k", file_stem(F.col(name))), wanted.withColumn("__k", file_stem(F.col(name)))
    return w.join(f.withColumnRenamed(name, "file"), "__k").drop("__k"), w.join(f, "__k", "left_anti").drop("__k")


def read_results(spark: SparkSession, path: str, exclude: Sequence[str] = (), required: str | None = None) -> DataFrame:
    """Rows (file, tokenizer, result) of JSON objects {tokenizer: {...}}, without the list of failures and without ``exclude``.

    With ``required``, a result that lacks this number is an error.
    """
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.from_json("value", "map<string,string>").alias("m"))
    rows = rows.select("file", F.explode("m").alias("tokenizer", "result")).filter("tokenizer != '_failed' and startswith(result, '{')")
    rows = rows.filter(~F.col("tokenizer").isin(list(exclude))) if exclude else rows
    if required:
        bad = rows.filter(F.get_json_object("result", f"$.{required}").isNull()).select("tokenizer").limit(1).collect()
        if bad:
            raise ValueError(f"{bad[0][0]} has no {required}")
    return rows


def result_values(results: DataFrame, field: str) -> DataFrame:
    """Rows (tokenizer, lang, value) of a field {lang: number} of results."""
    values = F.from_json(F.get_json_object("result", f"$.{field}"), "map<string,double>")
    return results.select("tokenizer", F.explode(values).alias("lang", "value"))


def _interleaved(examples: DataFrame, lang: str, order: str) -> DataFrame:
    """Examples of all languages in turn, so that a limit takes from each."""
    return interleave(examples, lang, order).withColumnRenamed("rk", "turn")


def entailment_examples(rows: DataFrame, order: str) -> DataFrame:
    """Rows (lang, turn, context, choices, label) of rows (lang, premise, hypothesis, label)."""
    choices = F.array(*[F.lit(c) for c in ENTAILMENT_CHOICES])
    got = rows.select(order, "lang", entailment_prompt(F.col("premise"), F.col("hypothesis")).alias("context"), choices.alias("choices"), "label")
    return _interleaved(got, "lang", order)


def cause_examples(rows: DataFrame, order: str) -> DataFrame:
    """Rows (lang, turn, context, choices, label) of rows (lang, premise, choice1, choice2, question, label)."""
    got = rows.select(order, "lang", cause_prompt(F.col("premise"), F.col("question")).alias("context"), cause_choices(F.col("choice1"), F.col("choice2")).alias("choices"), "label")
    return _interleaved(got, "lang", order)


def minimal_pair_examples(rows: DataFrame, order: str) -> DataFrame:
    """Rows with an empty context whose first choice is the good sentence; ``lang`` is the paradigm."""
    got = rows.select(order, F.col("paradigm").alias("lang"), F.lit("").alias("context"), F.array("sentence_good", "sentence_bad").alias("choices"), F.lit(0).alias("label"))
    return _interleaved(got, "lang", order)


def acceptability_examples(rows: DataFrame) -> DataFrame:
    return rows.select(F.lit("en").alias("lang"), "sentence", "label")


def qa_examples(rows: DataFrame) -> DataFrame:
    """Questions with their prompt and all their reference answers."""
    return rows.select(F.lit("en").alias("lang"), "context", "question", answer_prompt(F.col("context"), F.col("question")).alias("prompt"), "answers")


def translation_examples(groups: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Rows (source_lang, target_lang, turn, source_text, reference_text) of groups that have both; unknown languages are an error."""
    wanted = sorted({k for pair in pairs for k in pair})
    there = {r[0] for r in groups.filter(F.col("lang").isin(wanted)).select("lang").distinct().collect()}
    if missing := [k for k in wanted if k not in there]:
        raise ValueError(f"no texts in {', '.join(missing)}")
    chosen = groups.sparkSession.createDataFrame(list(pairs), "source_lang string, target_lang string")
    side = lambda lang, text: groups.select("group_id", F.col("lang").alias(lang), F.col("text").alias(text))
    both = chosen.join(side("source_lang", "source_text"), "source_lang").join(side("target_lang", "reference_text"), ["group_id", "target_lang"])
    both = both.withColumn("pair", F.concat_ws(":", "source_lang", "target_lang"))
    return _interleaved(both, "pair", "group_id").select("source_lang", "target_lang", "turn", "source_text", "reference_text")
