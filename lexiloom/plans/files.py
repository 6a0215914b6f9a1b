"""Queries that write the test tables in every source format and read them back through the readers, with their SQL.

The formats are files of lines, so line feeds and tabs in texts become blanks first.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions import text as tx
from lexiloom.operators import groups, vocab
from lexiloom.operators.frames import numbered, shared_folder
from lexiloom.plans.catalogue import BOARD, GROUPS, MATRIX, TOPK, board, docs, freq, matrix, parallel_groups, query, rounded, table
from lexiloom.sources import readers, sinks

LINE = "trim(translate({}, chr(10) || chr(9) || chr(13), '   '))"
BITEXT = f"""SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS group_id, a, b FROM (SELECT x.conv_id, x.turn, {LINE.format("x.text")} AS a, {LINE.format("y.text")} AS b
 FROM conversations x JOIN conversations y ON y.conv_id = x.conv_id AND y.turn = x.turn + 1 WHERE x.role = 'user') WHERE a <> '' AND b <> ''"""
SIDES = f"SELECT group_id, 'en' AS lang, md5(a) AS digest FROM ({BITEXT}) UNION ALL SELECT group_id, 'mi', md5(b) FROM ({BITEXT})"
LINES = f"SELECT group_id, lang, {LINE.format('text')} AS text FROM ({GROUPS})"


def folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/lexiloom/files-{uuid.uuid4().hex}"


def place(lines: DataFrame, path: str, name: str, order: list[str], compression: str = "none") -> str:
    """Writes the column ``value`` as the one file ``path/name``, in order; a file of a text format is one task's work."""
    spark = lines.sparkSession
    part = f"{path}/.{uuid.uuid4().hex}"
    lines.orderBy(*order).select("value").coalesce(1).write.option("compression", compression).text(part)
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    written = next(s.getPath() for s in fs.listStatus(fs_path(part)) if s.getPath().getName().startswith("part-"))
    fs.rename(written, fs_path(f"{path}/{name}"))
    fs.delete(fs_path(part), True)
    return f"{path}/{name}"


def one_line(c: Column) -> Column:
    return F.trim(F.translate(c, "\n\t\r", "   "))


def bitext(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (group_id, a, b): a user's turn and what follows it."""
    rows = table(spark, sf_dir, "conversations")
    later = rows.select("conv_id", (F.col("turn") - 1).alias("turn"), one_line(F.col("text")).alias("b"))
    both = rows.filter("role = 'user'").select("conv_id", "turn", one_line(F.col("text")).alias("a")).join(later, ["conv_id", "turn"]).filter("a != '' and b != ''")
    return numbered(both, ["conv_id", "turn"], "group_id").select((F.col("group_id") - 1).alias("group_id"), "a", "b")


def digested(rows: DataFrame) -> DataFrame:
    return rows.select("group_id", "lang", F.md5("text").alias("digest"))


def json_line(**fields: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]))


def bitext_query(name: str, write: Callable[[DataFrame, str], dict]) -> None:
    """Registers a query that writes the bitext in a format and reads it with the reader of that format."""
    reader = name.removeprefix("source_")

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return digested(readers.read_groups(spark, reader, **write(bitext(spark, sf_dir), folder(spark))))

    run.__name__ = name
    query(SIDES)(run)


def _tsv(rows: DataFrame, path: str) -> dict:
    odd = rows.limit(1).select(F.lit("en\tmi\tonly three").alias("value"), F.lit(-1).cast("long").alias("group_id"))  # a line that is to be left out
    lines = rows.select(F.concat_ws("\t", F.lit("en"), F.lit("mi"), "a", "b").alias("value"), "group_id").unionByName(odd)
    return {"path": place(lines, path, "pairs.tsv", ["group_id"])}


def _pair_rows(rows: DataFrame, path: str) -> dict:
    return {"path": place(rows.select("group_id", json_line(sl=F.lit("en"), src=F.col("a"), tl=F.lit("mi"), trg=F.col("b")).alias("value")), path, "en_mi.jsonl", ["group_id"])}


def _csv(rows: DataFrame, path: str) -> dict:
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    head = rows.limit(1).select(F.lit("en,mi").alias("value"), F.lit(-1).cast("long").alias("group_id"))
    return {"path": place(rows.select(F.concat_ws(",", quoted("a"), quoted("b")).alias("value"), "group_id").unionByName(head), path, "pairs.csv", ["group_id"])}


def _line_pairs(rows: DataFrame, path: str) -> dict:
    a, b = (place(rows.select("group_id", F.col(c).alias("value")), path, f"text.{c}", ["group_id"]) for c in "ab")
    return {"path_a": a, "path_b": b, "lang_a": "en", "lang_b": "mi"}


def _transcript(rows: DataFrame, path: str) -> dict:
    parts = F.array(F.lit("; a comment"), F.concat(F.lit("M: "), "a"), F.concat(F.lit("C: "), "b"), F.lit(""))
    lines = rows.select("group_id", F.posexplode(parts).alias("i", "value"))
    return {"path": place(lines, path, "talk.txt", ["group_id", "i"]), "tags": {"M:": "en", "C:": "mi"}}


def _english(rows: DataFrame, path: str) -> dict:
    return {"path": place(rows.select("group_id", json_line(english=F.col("a"), non_english=F.col("b")).alias("value")), path, "rows.jsonl", ["group_id"]), "config": "en-mi"}


def _groups(rows: DataFrame, path: str) -> dict:
    blank = rows.limit(1).select(F.lit("").alias("value"), F.lit(-1).cast("long").alias("group_id"))
    return {"path": place(rows.select(json_line(en=F.col("a"), mi=F.col("b")).alias("value"), "group_id").unionByName(blank), path, "groups.jsonl", ["group_id"])}


for _name, _write in (("tsv_pairs", _tsv), ("pair_rows", _pair_rows), ("csv_pairs", _csv), ("line_pairs", _line_pairs), ("transcript", _transcript), ("english_pairs", _english), ("jsonl_groups", _groups)):
    bitext_query(f"source_{_name}", _write)


@query(f"SELECT lang, digest, count(*) AS n FROM ({SIDES}) GROUP BY ALL")
def source_translations(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark)
    rows = bitext(spark, sf_dir).select(F.create_map(F.lit("en"), "a", F.lit("mi"), "b").alias("translation"))
    rows.unionByName(rows.limit(1).select(F.create_map(F.lit("en"), F.lit("one side")).alias("translation"))).write.parquet(path)
    got = digested(readers.read_groups(spark, "translations", ["en", "mi"], path=path))
    return got.groupBy("lang", "digest").agg(F.count(F.lit(1)).alias("n"))


def by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parallel_groups(spark, sf_dir).withColumn("text", one_line(F.col("text")))


#: Ids are ordered as strings, as files of strings have them.
BY_ID = f"SELECT dense_rank() OVER (ORDER BY group_id::VARCHAR) - 1 AS group_id, lang, md5(text) AS digest FROM ({LINES})"


@query(BY_ID)
def source_jsonl_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, rows = folder(spark), by_language(spark, sf_dir)
    for lang in ("en", "fr", "de", "es"):
        place(rows.filter(F.col("lang") == lang).select("group_id", json_line(id=F.col("group_id").cast("string"), text=F.col("text")).alias("value")), path, f"{lang}.jsonl", ["group_id"])
    return digested(readers.read_groups(spark, "jsonl_by_lang", path=path))


@query(f"SELECT dense_rank() OVER (ORDER BY group_id::VARCHAR) - 1 AS group_id, lang, md5(text) AS digest FROM ({LINES}) WHERE group_id IN (SELECT group_id FROM ({LINES}) WHERE lang IN ('en', 'fr', 'de', 'es') GROUP BY group_id HAVING count(*) = 4)")
def source_joined_for_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parallel sources are cut to the groups that all languages have; ids are numbered after that."""
    rows = by_language(spark, sf_dir).withColumn("key", F.col("group_id").cast("string"))
    kept = readers.joined_groups(rows, "jsonl_by_lang", ["en", "fr", "de", "es"])
    ids = numbered(kept.select("key").distinct(), ["key"], "rank")
    return digested(kept.join(ids, "key").select((F.col("rank") - 1).alias("group_id"), "lang", "text"))


@query(f"SELECT lang, digest, count(*) AS n FROM (SELECT lang, md5(text) AS digest FROM ({LINES}) UNION ALL SELECT lang, md5(text || '.') FROM ({LINES})) GROUP BY ALL")
def source_parquet_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two granularities, each a folder with a Parquet file per language, one after the other."""
    path, rows = folder(spark), by_language(spark, sf_dir)
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for k, text in (("paragraph", F.col("text")), ("sentence", F.concat("text", F.lit(".")))):
        for lang in ("en", "fr", "de", "es"):
            part = f"{path}/.{k}-{lang}"
            rows.filter(F.col("lang") == lang).select(F.col("group_id").alias("uniq_id"), text.alias("src_text"), F.lit("x").alias("other")).coalesce(1).write.parquet(part)
            written = next(s.getPath() for s in fs.listStatus(fs_path(part)) if s.getPath().getName().startswith("part-"))
            fs.mkdirs(fs_path(f"{path}/{k}"))
            fs.rename(written, fs_path(f"{path}/{k}/{lang}.parquet"))
    got = digested(readers.read_groups(spark, "parquet_by_lang", paths=[f"{path}/paragraph", f"{path}/sentence"]))
    return got.groupBy("lang", "digest").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT row_number() OVER (ORDER BY doc_id) - 1 AS group_id, lang, md5(text) AS digest FROM documents WHERE length(text) > 0")
def source_parquet_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digested(readers.read_groups(spark, "parquet_text", path=f"{sf_dir}/documents.parquet", order="doc_id"))


@query(f"SELECT row_number() OVER (ORDER BY f, group_id) - 1 AS group_id, 'und' AS lang, md5(t) AS digest FROM (SELECT 0 AS f, group_id, a AS t FROM ({BITEXT}) UNION ALL SELECT 1, group_id, b FROM ({BITEXT}))")
def source_plain_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, rows = folder(spark), bitext(spark, sf_dir)
    for name, c in (("0", "a"), ("1", "b")):
        place(rows.select("group_id", F.col(c).alias("value")), path, f"{name}.txt", ["group_id"])
    return digested(readers.read_groups(spark, "plain_text", path=path))


@query(f"SELECT dense_rank() OVER (ORDER BY 'v' || group_id || ';;w') - 1 AS group_id, lang, digest FROM ({SIDES})")
def source_streamed_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, rows = folder(spark), bitext(spark, sf_dir)
    verses = F.array(F.concat(F.lit("v"), F.col("group_id").cast("string")), F.lit("w"))
    for lang, c in (("en", "a"), ("mi", "b")):
        place(rows.select("group_id", json_line(lang=F.lit(lang), verses=verses, text=F.col(c)).alias("value")), path, f"{lang}.jsonl", ["group_id"])
    return digested(readers.read_groups(spark, "streamed_groups", path=path))


@query(f"""WITH t AS (SELECT 0 AS f, group_id, a AS t FROM ({BITEXT}) UNION ALL SELECT 1, group_id, b FROM ({BITEXT})), w AS (SELECT *, len(regexp_extract_all(lower(nfc_normalize(t)), '[\\p{{L}}\\p{{N}}_]+')) AS n FROM t),
 s AS (SELECT *, sum(n) OVER (ORDER BY f, group_id) AS upto FROM w)
SELECT row_number() OVER (ORDER BY f, group_id) - 1 AS group_id, 'und' AS lang, md5(t) AS digest FROM s WHERE upto - n < 5000""")
def source_jsonl_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean shards come before noisy ones until the words are enough; the budget is the feature."""
    path, rows = folder(spark), bitext(spark, sf_dir)
    for name, c in (("a_noisy_docs", "b"), ("b_clean_docs", "a"), ("c_other", "a")):
        place(rows.select("group_id", json_line(text=F.col(c)).alias("value")), path, f"{name}.jsonl.gz", ["group_id"], "gzip")
    return digested(readers.read_groups(spark, "jsonl_budget", path=path, words=5000))


@query("SELECT DISTINCT lang AS stem FROM documents")
def source_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, rows = folder(spark), docs(spark, sf_dir).select(F.col("lang").alias("value"))
    for lang in ("en", "fr", "de", "es"):
        place(rows.filter(F.col("value") == lang).distinct(), path, f"{lang}.jsonl", ["value"])
    place(rows.distinct(), path, "other.txt", ["value"])
    return readers.discover(spark, path).select("stem")


@query(f"SELECT source, count(*) AS n FROM (SELECT 'tsv_pairs' AS source FROM ({SIDES}) UNION ALL SELECT 'pair_rows' FROM ({SIDES})) GROUP BY source")
def source_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bitext(spark, sf_dir)
    pooled = readers.pool_sources(spark, {"tsv_pairs": _tsv(rows, folder(spark)), "pair_rows": _pair_rows(rows, folder(spark))})
    return pooled.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT lang_a, lang_b, min(stem) AS stem FROM (SELECT least(a, b) AS lang_a, greatest(a, b) AS lang_b, a || '_' || b AS stem FROM (SELECT DISTINCT x.lang AS a, y.lang AS b FROM documents x JOIN documents y ON x.source = y.source AND x.lang <> y.lang)) GROUP BY ALL")
def canonical_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir).select("source", "lang").distinct()
    pairs = d.join(d.withColumnRenamed("lang", "other"), "source").filter("lang != other").select("lang", "other").distinct()
    return groups.canonical_pairs(pairs.withColumn("stem", F.concat_ws("_", "lang", "other")), "lang", "other", "stem")


@query(f"SELECT tokenizer, lang, round(parity, 6) AS value FROM ({MATRIX}) WHERE tokenizer <> 'char'")
def source_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results written as one JSON object with a list of failures, read back with one tokenizer left out and the spread required."""
    entries = F.map_from_entries(F.collect_list(F.struct("lang", F.round("parity", 6))))
    per = matrix(spark, sf_dir).groupBy("tokenizer").agg(F.struct(entries.alias("token_parity"), (F.max("parity") / F.min("parity")).alias("token_parity_spread")).alias("r"))
    whole = per.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("tokenizer", "r")))).alias("j")).select(F.concat(F.expr("left(j, length(j) - 1)"), F.lit(', "_failed": ["x"]}')).alias("value"))
    path = place(whole, folder(spark), "results.json", ["value"])
    return readers.result_values(readers.read_results(spark, path, ["char"], "token_parity_spread"), "token_parity")


@query("SELECT lang, CASE WHEN lang IN ('en', 'fr') THEN 'skipped' ELSE 'written' END AS status, count(*) AS n FROM documents GROUP BY lang")
def sink_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second run skips the languages that the first one wrote; all are there afterwards."""
    path, rows = folder(spark), docs(spark, sf_dir)
    sinks.write_by_lang(rows.filter("lang in ('en', 'fr')"), path)
    status = sinks.write_by_lang(rows, path)
    return spark.read.json(path).groupBy("lang").agg(F.count(F.lit(1)).alias("n")).join(status, "lang").select("lang", "status", "n")


@query(f"SELECT id, md5(span) AS digest, total, n_langs FROM ({TOPK})")
def sink_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary and its counts by language as JSON, read back."""
    path, f = folder(spark), freq(spark, sf_dir)
    top = vocab.topk(f, 200)
    place(sinks.vocabulary_json(top).withColumnRenamed("json", "value"), path, "vocab.json", ["value"])
    place(sinks.vocabulary_stats(vocab.per_lang(f, top)).withColumnRenamed("json", "value"), path, "vocab_stats.json", ["id"])
    ids = spark.read.text(f"{path}/vocab.json").select(F.explode(F.from_json("value", "map<string,int>")).alias("token", "id"))
    told = spark.read.text(f"{path}/vocab_stats.json").select(F.from_json("value", "token string, total long, per_lang map<string,long>").alias("j")).select("j.*")
    joined = ids.join(told, "token")
    return rounded(joined.select("id", F.md5(tx.token_bytes(F.col("token"))).alias("digest"), "total", F.size("per_lang").alias("n_langs")))


@query(f"SELECT tokenizer, round(spread, 6) AS spread FROM ({BOARD})")
def sink_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sinks.results_json(rounded(board(spark, sf_dir)))
    path = place(rows.select(F.concat_ws("\t", "tokenizer", "json").alias("value")), folder(spark), "results.tsv", ["value"])
    cells = spark.read.text(path).select(F.split("value", "\t").alias("c"))
    return cells.select(F.col("c")[0].alias("tokenizer"), F.get_json_object(F.col("c")[1], "$.spread").cast("double").alias("spread"))


@query(f"SELECT tokenizer || ' ' || printf('%.4f', round(spread, 6)) AS line FROM ({BOARD})")
def sink_chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.chart_table(rounded(board(spark, sf_dir)), ["tokenizer", "spread"])


@query("SELECT lang, CASE WHEN doc_id % 3 = 0 THEN 'skipped' ELSE 'written' END AS status, count(*) AS docs, sum(octet_length(encode(text)))::BIGINT AS bytes FROM documents GROUP BY ALL")
def sink_cache_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs(spark, sf_dir).withColumn("status", F.when(F.col("doc_id") % 3 == 0, "skipped").otherwise("written"))
    return rounded(sinks.cache_status(rows))
