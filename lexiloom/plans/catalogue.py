"""All queries over the test tables and the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions import text as tx
from lexiloom.operators import bpe, contamination, dedup, groups, metrics, ordering, prep, results, scoring, stability, stats, vocab
from lexiloom.streaming import streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

TOKENS = r"regexp_extract_all(text, '[ \t\n\x0B\f\r]*[^ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+')"
WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
SOLID = r"len(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+'))"
BYTES = "octet_length(encode(text))"
KEY = f"md5(array_to_string({WORDS}, ' '))"
GROUPS = "SELECT row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS group_id, lang, text FROM documents"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c).cast("long").alias(c) if t in ("int", "smallint") else F.col(c) for c, t in df.dtypes])


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")


def spread_out(df: DataFrame) -> DataFrame:
    """A table in few files dealt out before expressions that are heavy per row; larger inputs arrive in many splits anyway."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def parallel_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.parallel(docs(spark, sf_dir), "doc_id")


def counted_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.counts(parallel_groups(spark, sf_dir), F.size(tx.pretokens(F.col("text"))))


COUNTED = f"SELECT *, {BYTES} AS n_bytes, len({TOKENS}) AS n_tokens, {SOLID} AS n_words FROM ({GROUPS})"
FREQ = f"SELECT lang, span, count(*) AS cnt FROM (SELECT lang, unnest({TOKENS}) AS span FROM documents) GROUP BY ALL"
NORM = r"array_to_string(list_filter(regexp_split_to_array(translate(lower({c}), '!' || chr(34) || '#$%&''()*+,-./:;<=>?@[\]^_`{{|}}~', ''), '[ \t\n\x0B\f\r]+'), lambda w: w NOT IN ('a', 'an', 'the', '')), ' ')"
RENYI = f"""SELECT lang, CASE WHEN count(*) > 1 THEN ln(sum(pow(cnt / total, 2.5))) / (1 - 2.5) / ln(count(*)) ELSE 0 END AS renyi
 FROM (SELECT *, sum(cnt) OVER (PARTITION BY lang) AS total FROM ({FREQ})) GROUP BY lang"""


@query(f"""WITH t AS (SELECT lang, {BYTES} AS n_bytes, len({TOKENS}) AS n_tokens, {SOLID} AS n_words FROM documents)
SELECT lang, round(compression, 6) AS compression, round(fertility, 6) AS fertility, tokens, texts, round(renyi, 6) AS renyi FROM
 (SELECT lang, avg(CASE WHEN n_tokens > 0 THEN n_bytes / n_tokens ELSE 0 END) AS compression, CASE WHEN sum(n_words) > 0 THEN sum(n_tokens) / sum(n_words) ELSE 0 END AS fertility,
  sum(n_tokens)::BIGINT AS tokens, count(*) AS texts FROM t GROUP BY lang) JOIN ({RENYI}) USING (lang)""")
def tok_eval_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread_out(docs(spark, sf_dir)).withColumn("spans", tx.pretokens(F.col("text")))
    per = metrics.by_lang(metrics.counts(rows, F.size("spans")))
    return rounded(per.join(metrics.renyi(metrics.frequencies(rows, F.col("spans"))), "lang"))


@query(f"""WITH f AS ({FREQ}), r AS ({RENYI}), c AS (SELECT lang, avg({BYTES} / len({TOKENS})) AS compression FROM documents GROUP BY lang),
 g AS (SELECT row_number() OVER (ORDER BY renyi) AS i, renyi FROM r)
SELECT round((SELECT avg(compression) FROM c), 6) AS avg_compression, round((SELECT (2 * sum(i * renyi) - (count(*) + 1) * sum(renyi)) / (count(*) * sum(renyi)) FROM g), 6) AS gini,
 round((SELECT sum({BYTES.replace("text", "span")} * cnt) / sum(cnt) FROM f), 6) AS avg_length, round((SELECT avg(CASE WHEN cnt = 1 THEN 1.0 ELSE 0 END) FROM f), 6) AS singletons""")
def tok_eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread_out(docs(spark, sf_dir)).withColumn("spans", tx.pretokens(F.col("text")))
    freq = metrics.frequencies(rows, F.col("spans"))
    one = metrics.by_lang(metrics.counts(rows, F.size("spans"))).agg(F.avg("compression").alias("avg_compression"))
    return rounded(one.crossJoin(metrics.gini(metrics.renyi(freq), "renyi")).crossJoin(metrics.span_report(freq)).select("avg_compression", "gini", "avg_length", "singletons"))


def parity_sql(measure: str) -> str:
    return f"""SELECT l.lang, coalesce(p.parity, 1.0) AS parity, p.parity IS NOT NULL AS paired FROM (SELECT DISTINCT lang FROM ({COUNTED})) l LEFT JOIN
 (SELECT x.lang, sum(x.{measure}) / sum(a.{measure}) AS parity FROM ({COUNTED}) x JOIN ({COUNTED}) a ON a.group_id = x.group_id AND a.lang = 'en' GROUP BY x.lang) p ON p.lang = l.lang"""


RELATIVE = f"SELECT lang, parity / exp(avg(ln(parity)) OVER ()) AS relative FROM ({parity_sql('n_tokens')})"


@query(f"SELECT lang, round(parity, 6) AS parity, paired FROM ({parity_sql('n_bytes')})")
def byte_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.parity(counted_groups(spark, sf_dir), "en", "n_bytes"))


@query(f"SELECT lang, round(parity, 6) AS parity, paired FROM ({parity_sql('n_tokens')})")
def token_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.parity(counted_groups(spark, sf_dir), "en"))


@query(f"SELECT lang, round(relative, 6) AS relative FROM ({RELATIVE})")
def parity_anchor_invariant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.anchor_invariant(metrics.parity(counted_groups(spark, sf_dir), "en")))


@query(f"SELECT round(max(parity) / min(parity), 6) AS spread FROM ({parity_sql('n_tokens')})")
def parity_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.spread(metrics.parity(counted_groups(spark, sf_dir), "en")))


@query(f"SELECT lang, round((sum(relative) OVER () - relative) / (count(*) OVER () - 1) / relative, 6) AS mean_parity FROM ({RELATIVE})")
def parity_reanchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.reanchored(metrics.anchor_invariant(metrics.parity(counted_groups(spark, sf_dir), "en"))))


MANIFEST = [("fr", "en"), ("de", "en"), ("es", "fr"), ("de", "fr")]


@query(f"""WITH m(lang, anchor) AS (VALUES {", ".join(map(str, MANIFEST))}), c AS ({COUNTED})
SELECT m.anchor, m.lang, round(sum(x.n_tokens) / sum(a.n_tokens), 6) AS parity FROM m JOIN c x ON x.lang = m.lang JOIN c a ON a.lang = m.anchor AND a.group_id = x.group_id GROUP BY ALL""")
def mixed_anchor_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = spark.createDataFrame(MANIFEST, "lang string, anchor string")
    return rounded(metrics.mixed_anchor(counted_groups(spark, sf_dir), manifest))


@query(f"SELECT group_id, lang, md5(text) AS digest FROM ({GROUPS}) WHERE group_id IN (SELECT group_id FROM ({GROUPS}) WHERE lang IN ('en', 'fr', 'de', 'es') GROUP BY group_id HAVING count(DISTINCT lang) = 4)")
def groups_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.intersected(parallel_groups(spark, sf_dir), ["en", "fr", "de", "es"]).select("group_id", "lang", F.md5("text").alias("digest"))


@query(f"SELECT group_id, count(*) AS n_langs, min(lang) AS first_lang, sum(length(text))::BIGINT AS chars FROM ({GROUPS}) GROUP BY group_id")
def groups_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = groups.wide(parallel_groups(spark, sf_dir))
    total = F.aggregate(F.map_values("texts"), F.lit(0).cast("long"), lambda a, t: a + F.length(t))
    return wide.select("group_id", F.size("texts").cast("long").alias("n_langs"), F.array_min(F.map_keys("texts")).alias("first_lang"), total.alias("chars"))


@query(f"""WITH s AS (SELECT group_id, string_agg(lang, ',' ORDER BY lang) AS signature FROM ({GROUPS}) GROUP BY group_id),
 b AS (SELECT *, (row_number() OVER (PARTITION BY signature ORDER BY group_id) - 1) // 4 AS block FROM s)
SELECT signature, block::BIGINT AS block, lang, md5(string_agg(text, ' ' ORDER BY group_id)) AS digest FROM b JOIN ({GROUPS}) USING (group_id) GROUP BY ALL""")
def group_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups_digest(ordering.same_signature(parallel_groups(spark, sf_dir), 4))


def groups_digest(df: DataFrame) -> DataFrame:
    return df.withColumn("digest", F.md5("text")).drop("text")


@query(f"SELECT doc_id, len({WORDS})::BIGINT AS n_words, len({TOKENS})::BIGINT AS n_pretokens, {SOLID}::BIGINT AS n_solid, {BYTES}::BIGINT AS n_bytes, {KEY} AS exact_key FROM documents")
def word_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return rounded(spread_out(docs(spark, sf_dir)).select("doc_id", F.size(tx.words(t)).alias("n_words"), F.size(tx.pretokens(t)).alias("n_pretokens"), tx.word_count(t).alias("n_solid"), F.octet_length(t).alias("n_bytes"), tx.exact_key(t).alias("exact_key")))


SHINGLED = f"""SELECT doc_id, unnest(CASE WHEN len(ws) >= 13 THEN list_distinct(list_transform(range(1, len(ws) - 11), lambda i: array_to_string(ws[i:i+12], ' '))) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE []::VARCHAR[] END) AS g
 FROM (SELECT doc_id, {WORDS} AS ws FROM documents)"""


@query(f"SELECT doc_id, count(*) AS n_shingles, min(md5(g)) AS least_key FROM ({SHINGLED}) GROUP BY doc_id")
def shingles_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread_out(docs(spark, sf_dir)).select("doc_id", F.explode(tx.shingles(F.col("text"), 13)).alias("g"))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_shingles"), F.min(tx.shingle_key(F.col("g"))).alias("least_key"))


@query(f"""SELECT doc_id, {BYTES} > 1001 AS was_cut, octet_length(encode(t))::BIGINT AS n_bytes, md5(t) AS digest FROM
 (SELECT doc_id, text, CASE WHEN {BYTES} <= 1001 THEN text ELSE left(text, (SELECT count(*) FROM (SELECT sum(octet_length(encode(c))) OVER (ORDER BY i) AS upto FROM
  (SELECT unnest(string_split(text, '')) AS c, unnest(range(len(string_split(text, '')))) AS i)) WHERE upto <= 1001)::INT) END AS t FROM documents)""")
def truncate_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = tx.truncated(F.col("text"), 1001)
    return docs(spark, sf_dir).select("doc_id", (F.octet_length("text") > 1001).alias("was_cut"), F.octet_length(cut).cast("long").alias("n_bytes"), F.md5(cut).alias("digest"))


@query(rf"""SELECT conv_id, turn, md5({NORM.format(c='text')}) AS answer,
 md5(split_part(text, chr(10), 1)) AS first_line FROM conversations""")
def normalize_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", F.md5(tx.normalized_answer(F.col("text"))).alias("answer"), F.md5(tx.first_line(F.col("text"))).alias("first_line"))


@query(f"SELECT min(doc_id) AS doc_id, {KEY} AS key, count(*) AS copies FROM documents GROUP BY key")
def dedup_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread_out(docs(spark, sf_dir))
    copies = rows.groupBy(tx.exact_key(F.col("text")).alias("key")).agg(F.count(F.lit(1)).alias("copies"))
    return dedup.drop_exact(rows, "doc_id").select("doc_id", tx.exact_key(F.col("text")).alias("key")).join(copies, "key").select("doc_id", "key", "copies")


@query(f"""SELECT lang, count(*) AS docs, sum(r)::BIGINT AS dropped_docs, sum(CASE WHEN r = 1 THEN n ELSE 0 END)::BIGINT AS dropped_bytes, round(avg(r), 6) AS drop_rate FROM
 (SELECT lang, {BYTES} AS n, CASE WHEN row_number() OVER (PARTITION BY {KEY} ORDER BY doc_id) > 1 THEN 1 ELSE 0 END AS r FROM documents) GROUP BY lang""")
def dedup_stats_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(dedup.dedup_stats(dedup.mark_exact(spread_out(docs(spark, sf_dir)), "doc_id"), "lang"))


def pairs_sql(at_least: int = 0) -> str:
    """Similar pairs of the least documents of classes of equal sets, and of each with its class."""
    return f"""WITH e AS (SELECT doc_id FROM documents WHERE len({WORDS}) >= {at_least}), g AS (SELECT doc_id, md5(g) AS g FROM ({SHINGLED}) WHERE doc_id IN (SELECT doc_id FROM e)),
 n AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, '' ORDER BY g)) AS d FROM g GROUP BY doc_id), r AS (SELECT d, min(doc_id) AS rep FROM n GROUP BY d), m AS (SELECT n.*, rep FROM n JOIN r USING (d)), s AS (SELECT g.* FROM g JOIN r ON rep = doc_id),
 c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL)
SELECT a, b, common, round(common / (na.n + nb.n - common), 6) AS jaccard FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE common / (na.n + nb.n - common) >= 0.8 UNION ALL SELECT rep, doc_id, n, 1.0 FROM m WHERE doc_id <> rep"""


@query(pairs_sql())
def near_dup_pairs_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(dedup.similar_pairs(spread_out(docs(spark, sf_dir)), "doc_id"))


@query()
def near_dup_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.minhash_edges(spread_out(docs(spark, sf_dir)), "doc_id")


#: The greedy rule walks the ids upwards: one step of the recursion settles one document with an earlier neighbour.
KEPT = f"""WITH RECURSIVE p AS MATERIALIZED ({pairs_sql(50)}), b AS MATERIALIZED (SELECT b, list(a) AS before, row_number() OVER (ORDER BY b) AS i FROM p GROUP BY b),
 w(i, dropped) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT b.i, CASE WHEN len(list_filter(b.before, lambda x: NOT list_contains(w.dropped, x))) > 0 THEN list_append(w.dropped, b.b) ELSE w.dropped END FROM w JOIN b ON b.i = w.i + 1)
SELECT doc_id FROM documents WHERE NOT list_contains((SELECT dropped FROM w ORDER BY i DESC LIMIT 1), doc_id)"""


@query(KEPT)
def near_dup_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs(spark, sf_dir)
    edges = dedup.similar_pairs(spread_out(rows), "doc_id", min_words=50).select("a", "b")
    return dedup.keep_greedily(rows.select("doc_id"), edges, "doc_id")


BENCH = f"SELECT DISTINCT item_id, unnest(CASE WHEN len(ws) >= 13 THEN list_transform(range(1, len(ws) - 11), lambda i: array_to_string(ws[i:i+12], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE []::VARCHAR[] END) AS g FROM (SELECT item_id, {WORDS} AS ws FROM benchmark)"


def contamination_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    bench = contamination.benchmark_shingles(table(spark, sf_dir, "benchmark"), "item_id", ["text"])
    return contamination.hits(spread_out(docs(spark, sf_dir)), bench, "doc_id")


@query(f"SELECT item_id, count(DISTINCT g) AS n_shingles, count(DISTINCT doc_id) AS n_docs, min(g) AS first_shingle FROM ({BENCH}) JOIN ({SHINGLED}) USING (g) GROUP BY item_id")
def contamination_by_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.per_item(contamination_hits(spark, sf_dir))


@query(f"""WITH h AS (SELECT DISTINCT item_id FROM ({BENCH}) JOIN ({SHINGLED}) USING (g))
SELECT (SELECT count(*) FROM benchmark) AS n_items, (SELECT count(*) FROM h) AS n_contaminated, (SELECT count(*) FROM documents WHERE length(text) > 0) AS docs_scanned, round((SELECT count(*) FROM h) / (SELECT count(*) FROM benchmark), 6) AS rate""")
def contamination_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(contamination.summary(table(spark, sf_dir, "benchmark"), contamination_hits(spark, sf_dir), docs(spark, sf_dir)))


RR = "SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rk FROM documents"


@query(f"SELECT doc_id, row_number() OVER (ORDER BY rk, source) AS pos FROM ({RR})")
def round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ordering.interleave(docs(spark, sf_dir).drop("text"), "source", "doc_id")
    return ordering.numbered(rows, ["rk", "source"], "pos").select("doc_id", "pos")


@query(f"SELECT doc_id, source, rk FROM ({RR}) WHERE rk <= 3")
def first_n_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ordering.first_n(docs(spark, sf_dir).drop("text"), 3, "source", "doc_id").select("doc_id", "source", "rk"))


@query(f"SELECT doc_id FROM ({RR}) ORDER BY rk, source LIMIT 40")
def stream_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.stream_limit(docs(spark, sf_dir).drop("text"), 40, "source", "doc_id").select("doc_id")


@query(f"SELECT doc_id, upto::BIGINT AS upto FROM (SELECT doc_id, w, sum(w) OVER (ORDER BY rk, source) AS upto FROM (SELECT *, {SOLID} AS w FROM ({RR}))) WHERE upto - w < 20000")
def word_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ordering.interleave(docs(spark, sf_dir).withColumn("w", tx.word_count(F.col("text"))).drop("text"), "source", "doc_id")
    return ordering.within_budget(rows, 20_000, F.col("w"), ["rk", "source"]).select("doc_id", "upto")


@query(f"""WITH p AS (SELECT doc_id, {BYTES} AS n, row_number() OVER (ORDER BY doc_id) AS rn FROM documents)
SELECT doc_id, (rn - 1) // 256 AS pool, (row_number() OVER (PARTITION BY (rn - 1) // 256 ORDER BY n, rn) - 1) // 32 AS chunk FROM p""")
def length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs(spark, sf_dir).select("doc_id", F.octet_length("text").alias("n"))
    return ordering.length_buckets(rows, ["doc_id"], F.col("n")).select("doc_id", "pool", "chunk")


@query(f"""WITH t AS (SELECT doc_id, len({TOKENS}) + 1 AS n FROM documents), s AS (SELECT doc_id, n, sum(n) OVER (ORDER BY doc_id) AS stop FROM t)
SELECT doc_id, n::BIGINT AS n_tokens, (stop - n)::BIGINT AS start, ((stop - n) // 5000)::BIGINT AS first_shard, ((stop - 1) // 5000)::BIGINT AS last_shard FROM s""")
def shard_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs(spark, sf_dir).select("doc_id", prep.token_count(F.col("text")).alias("n"))
    return ordering.shards(rows, ["doc_id"], F.col("n"), 5000).select("doc_id", "n_tokens", "start", "first_shard", "last_shard")


@query("SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) AS idx, (row_number() OVER (ORDER BY doc_id) - 1) % 5 = 0 AS validation FROM documents")
def stride_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.stride_split(docs(spark, sf_dir).select("doc_id"), ["doc_id"], 0.2)


@query("SELECT doc_id FROM documents ORDER BY md5('7:' || doc_id), doc_id LIMIT 50")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.sampled(docs(spark, sf_dir).select("doc_id"), 50, "doc_id", 7)


@query(f"SELECT group_id, lang, row_number() OVER (PARTITION BY group_id ORDER BY md5('3:' || group_id || ':' || lang), lang) - 1 AS turn FROM ({GROUPS})")
def language_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ordering.rotation(parallel_groups(spark, sf_dir).drop("text"), "group_id", "lang", 3))


@query("""WITH d AS (SELECT date_trunc('day', ts)::TIMESTAMP AS day, avg(value) AS fairness, count(*) AS compression FROM events GROUP BY 1)
, f AS (SELECT day, coalesce(fairness < lag(fairness, 3) OVER (ORDER BY day), false) AS fairness_falls, coalesce(compression < lag(compression, 3) OVER (ORDER BY day), false) AS compression_falls FROM d)
SELECT *, fairness_falls AND compression_falls AS both_fall FROM f""")
def trend_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "events").groupBy(F.date_trunc("day", "ts").alias("day")).agg(F.avg("value").alias("fairness"), F.count(F.lit(1)).alias("compression"))
    return ordering.trend_flags(days, "day", "fairness", "compression").select("day", "fairness_falls", "compression_falls", "both_fall")


@query("""WITH r AS (SELECT conv_id, turn, length(text)::DOUBLE AS reward FROM conversations)
SELECT a.conv_id, a.turn, round(sum(b.reward * pow(0.5, b.turn - a.turn)), 4) AS to_go FROM r a JOIN r b ON b.conv_id = a.conv_id AND b.turn >= a.turn GROUP BY ALL""")
def reward_to_go(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").cast("double").alias("reward"))
    return rounded(ordering.reward_to_go(rows, "conv_id", "turn", "reward", 0.5).select("conv_id", "turn", "to_go"), 4)


@query("""WITH r AS (SELECT conv_id, turn, role, length(text)::DOUBLE AS r FROM conversations), b AS (SELECT conv_id, avg(m) AS base FROM (SELECT conv_id, role, avg(r) AS m FROM r GROUP BY ALL) GROUP BY conv_id)
SELECT conv_id, turn, round(r - base, 6) AS advantage FROM r JOIN b USING (conv_id)""")
def group_advantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length("text").cast("double").alias("r"))
    return rounded(ordering.group_advantage(rows, "conv_id", "role", "r").select("conv_id", "turn", "advantage"))


def cut_sql(limit: int) -> str:
    """The longest prefix of whole characters of at most ``limit`` bytes."""
    return f"""CASE WHEN {BYTES} <= {limit} THEN text ELSE left(text, (SELECT count(*) FROM (SELECT sum(octet_length(encode(c))) OVER (ORDER BY i) AS upto FROM
 (SELECT unnest(string_split(text, '')) AS c, unnest(range(len(string_split(text, '')))) AS i)) WHERE upto <= {limit})::INT) END"""


#: What preparation keeps: the first of equal keys in the order of the stream, tokens of the cut text and the end mark.
CUT_TOKENS = TOKENS.replace("(text,", "(cut,")
PREP = f"""SELECT lang, n_bytes, cut, len({CUT_TOKENS}) + 1 AS n_tokens FROM (SELECT lang, {BYTES} AS n_bytes, {cut_sql(4096)} AS cut FROM
 (SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY rk, source) AS i FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rk FROM documents) WHERE length(text) > 0) WHERE i = 1)"""


@query(f"SELECT lang, count(*) AS docs, sum(n_tokens)::BIGINT AS tokens, sum(n_bytes)::BIGINT AS bytes, sum(CASE WHEN n_bytes > 4096 THEN 1 ELSE 0 END)::BIGINT AS truncated FROM ({PREP}) GROUP BY lang")
def prep_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.prepare(spread_out(docs(spark, sf_dir)), "doc_id").accounting.select("lang", "docs", "tokens", "bytes", "truncated")


@query(f"""WITH a AS (SELECT lang, count(*) AS docs, sum(n_tokens)::BIGINT AS tokens, sum(n_bytes)::BIGINT AS bytes FROM ({PREP}) GROUP BY lang)
SELECT lang, docs, tokens, bytes, round(tokens / sum(tokens) OVER (), 6) AS token_share, round(bytes / tokens, 6) AS compression FROM a""")
def prep_lang_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(prep.lang_shares(prep.prepare(spread_out(docs(spark, sf_dir)), "doc_id").accounting))


@query()
def prep_shard_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = prep.shard_meta(prep.prepare(spread_out(docs(spark, sf_dir)), "doc_id", options=prep.PrepOptions(near_threshold=0.8)).accounting)
    return rounded(meta.withColumn("by_lang", F.to_json("by_lang")))


def freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.frequencies(spread_out(docs(spark, sf_dir)), tx.pretokens(F.col("text")))


TOPK = f"SELECT row_number() OVER (ORDER BY total DESC, span) - 1 AS id, * FROM (SELECT span, sum(cnt)::BIGINT AS total, count(DISTINCT lang) AS n_langs FROM ({FREQ}) GROUP BY span ORDER BY total DESC, span LIMIT 200)"


@query(TOPK)
def vocab_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(vocab.topk(freq(spark, sf_dir), 200))


@query(f"SELECT round((SELECT sum(total) FROM ({TOPK})) / (SELECT sum(cnt) FROM ({FREQ})), 6) AS coverage, round((SELECT avg(CASE WHEN n_langs > 1 THEN 1.0 ELSE 0 END) FROM ({TOPK})), 6) AS cross_lingual_share")
def vocab_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = freq(spark, sf_dir)
    return rounded(vocab.snapshot(f, vocab.topk(f, 200)))


@query(f"""WITH a AS (SELECT span FROM ({FREQ}) WHERE lang = 'fr' ORDER BY cnt DESC, span LIMIT 300), b AS (SELECT span FROM ({FREQ}) WHERE lang = 'es' ORDER BY cnt DESC, span LIMIT 300)
SELECT round((SELECT count(*) FROM a JOIN b USING (span)) / (SELECT count(*) FROM (SELECT span FROM a UNION SELECT span FROM b)), 6) AS churn""")
def vocab_churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = freq(spark, sf_dir)
    return rounded(vocab.churn(vocab.topk(f.filter("lang = 'fr'"), 300), vocab.topk(f.filter("lang = 'es'"), 300)))


@query(f"SELECT octet_length(encode(span))::BIGINT AS span_length, sum(cnt)::BIGINT AS cnt FROM ({FREQ}) GROUP BY 1")
def span_length_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.span_length_histogram(freq(spark, sf_dir))


CHARS = f"SELECT span, sum(cnt) AS w, list_filter(string_split(span, ''), lambda c: c <> '') AS s FROM ({FREQ}) GROUP BY span"


@query(f"SELECT s[i] AS \"left\", s[i + 1] AS \"right\", sum(w)::BIGINT AS n FROM (SELECT s, w, unnest(range(1, len(s))) AS i FROM ({CHARS})) GROUP BY ALL")
def pair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = freq(spark, sf_dir).groupBy("span").agg(F.sum("cnt").alias("w")).withColumn("s", tx.characters(F.col("span")))
    return vocab.pair_counts(types, "s", "w")


@query(f"SELECT lang, sum(CASE WHEN id IS NOT NULL THEN 1 ELSE octet_length(encode(span)) END * cnt)::BIGINT AS n_ids FROM ({FREQ}) LEFT JOIN (SELECT id, span FROM ({TOPK})) USING (span) GROUP BY lang")
def spans_to_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = freq(spark, sf_dir)
    rows = vocab.to_ids(f, vocab.topk(f, 200))
    return rows.groupBy("lang").agg(F.sum(F.col("n_ids") * F.col("cnt")).alias("n_ids"))


def roundtrip(rows: DataFrame, merges: bpe.Merges, split: Callable = tx.pretokens) -> DataFrame:
    got = bpe.decoded(bpe.encoded(rows, merges, split=split), merges)
    return got.select("doc_id", F.octet_length("decoded").cast("long").alias("n_bytes"), F.md5("decoded").alias("digest"))


ROUNDTRIP = f"SELECT doc_id, {BYTES}::BIGINT AS n_bytes, md5(text) AS digest FROM documents"


@query(ROUNDTRIP)
def bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread_out(docs(spark, sf_dir))
    return roundtrip(rows, bpe.fit_bpe(rows, 400))


@query()
def bpe_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread_out(docs(spark, sf_dir))
    return bpe.harvested(rows, bpe.fit_bpe(rows, 400), 300)


@query(ROUNDTRIP)
def superbpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread_out(docs(spark, sf_dir))
    merges = bpe.fit_superbpe(rows, 320)
    return roundtrip(rows, merges, lambda c: F.regexp_extract_all(c, F.lit("[^\n]*\n|[^\n]+"), F.lit(0)))


@query(ROUNDTRIP)
def parity_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread_out(docs(spark, sf_dir))
    dev = rows.filter("doc_id % 10 = 0")
    return roundtrip(rows, bpe.fit_parity_bpe(rows.filter("doc_id % 10 > 0"), dev, 320))


@query("""WITH v AS (SELECT l_suppkey, sum(l_extendedprice * (1 - l_discount)) AS r FROM lineitem GROUP BY 1), i AS (SELECT r, row_number() OVER (ORDER BY r) AS i FROM v)
SELECT round((2 * sum(i * r) - (count(*) + 1) * sum(r)) / (count(*) * sum(r)), 6) AS gini FROM i""")
def gini_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    revenue = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
    return rounded(metrics.gini(revenue, "r"))


AVERAGE_RANK = "rank() OVER (PARTITION BY {k} ORDER BY {v}) + (count(*) OVER (PARTITION BY {k}, {v}) - 1) / 2.0"


@query(f"SELECT p_brand, round(corr(x, y), 6) AS rho, count(*) AS n FROM (SELECT p_brand, {AVERAGE_RANK.format(k='p_brand', v='p_size')} AS x, {AVERAGE_RANK.format(k='p_brand', v='p_retailprice')} AS y FROM part) GROUP BY p_brand")
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.spearman(table(spark, sf_dir, "part"), "p_size", "p_retailprice", ["p_brand"]))


@query("SELECT p_type, round(corr(p_size, p_retailprice), 6) AS r, round(pow(corr(p_size, p_retailprice), 2), 6) AS r2, count(*) AS n FROM part GROUP BY p_type")
def pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.pearson(table(spark, sf_dir, "part"), "p_size", "p_retailprice", ["p_type"]))


@query("""WITH r AS (SELECT o_orderpriority AS g, o_totalprice AS v, rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2.0 AS r FROM orders),
 s AS (SELECT g, sum(r) AS s, count(*) AS m FROM r GROUP BY g), t AS (SELECT sum(pow(c, 3) - c) AS ties FROM (SELECT count(*)::DOUBLE AS c FROM orders GROUP BY o_totalprice))
SELECT round((12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - ties / (n * n * n - n)), 4) AS h, groups FROM (SELECT sum(m)::DOUBLE AS n, sum(s * s / m) AS q, count(*) AS groups FROM s), t""")
def kruskal_h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.kruskal(table(spark, sf_dir, "orders"), "o_totalprice", "o_orderpriority").select(F.round("h", 4).alias("h"), "groups")


@query("""WITH q AS (SELECT o_orderpriority, quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.5) AS median, quantile_cont(o_totalprice, 0.75) AS q3 FROM orders GROUP BY 1)
SELECT o_orderpriority, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, min(CASE WHEN v THEN o_totalprice END) AS low, max(CASE WHEN v THEN o_totalprice END) AS high, sum(CASE WHEN v THEN 0 ELSE 1 END)::BIGINT AS outliers
FROM (SELECT *, o_totalprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS v FROM orders JOIN q USING (o_orderpriority)) GROUP BY ALL""")
def tukey_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.tukey(table(spark, sf_dir, "orders"), "o_totalprice", ["o_orderpriority"]))


EXCLUSIVE = """WITH r AS (SELECT s_nationkey, s_suppkey, s_acctbal AS v, row_number() OVER w AS i, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_acctbal)),
 j AS (SELECT *, greatest(1, least(3 * (n + 1) // 4, n - 1)) AS j FROM r WHERE n > 1), d AS (SELECT *, 3 * (n + 1) - 4 * j AS d FROM j),
 q AS (SELECT s_nationkey, sum(CASE WHEN i = j THEN v * (4 - d) WHEN i = j + 1 THEN v * d ELSE 0 END) / 4 AS quartile FROM d GROUP BY 1)"""


@query(f"{EXCLUSIVE} SELECT s_suppkey, round(quartile, 6) AS quartile, s_acctbal >= quartile AS worst FROM supplier JOIN q USING (s_nationkey)")
def worst_quartile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.worst_quartile(table(spark, sf_dir, "supplier"), "s_acctbal", ["s_nationkey"]).select("s_suppkey", "quartile", "worst"))


@query("""SELECT s_suppkey, round((s_acctbal - m) / s, 6) AS z FROM (SELECT *, avg(s_acctbal) OVER w AS m, stddev_pop(s_acctbal) OVER w AS s, count(*) OVER w AS n FROM supplier WINDOW w AS (PARTITION BY s_nationkey)) WHERE n >= 2 AND s > 0""")
def family_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.zscores(table(spark, sf_dir, "supplier"), "s_acctbal", ["s_nationkey"]).select("s_suppkey", "z"))


@query("""SELECT (CASE WHEN p_size > mx THEN 'high' ELSE 'low' END) || '-' || (CASE WHEN p_retailprice > my THEN 'high' ELSE 'low' END) AS quadrant, count(*) AS n
FROM part, (SELECT quantile_cont(p_size, 0.5) AS mx, quantile_cont(p_retailprice, 0.5) AS my FROM part) GROUP BY 1""")
def quadrant_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.quadrants(table(spark, sf_dir, "part"), "p_size", "p_retailprice").groupBy("quadrant").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_mktsegment, round(avg(c_acctbal), 6) AS mean, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) >= 5")
def penalized_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.grouped_mean(table(spark, sf_dir, "customer"), "c_acctbal", "c_mktsegment", 5))


#: A text feature in place of a model's score: distinct over all words.
LABELLED = f"SELECT d.lang, l.quality, l.toxic, round(len(list_distinct(ws)) / len(ws), 9) AS score FROM (SELECT *, {WORDS} AS ws FROM documents) d JOIN labels l USING (doc_id) WHERE len(ws) > 0"


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id").withColumn("ws", tx.words(F.col("text"))).filter("size(ws) > 0")
    return rows.select("lang", "quality", "toxic", F.round(F.size(F.array_distinct("ws")) / F.size("ws"), 9).alias("score"))


@query(f"SELECT lang, round(avg(CASE WHEN (score >= 0.5) = (quality = 1) THEN 1.0 ELSE 0 END), 6) AS accuracy, count(*) AS n FROM ({LABELLED}) GROUP BY GROUPING SETS ((lang), ())")
def accuracy_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scoring.accuracy(labelled(spark, sf_dir), (F.col("score") >= 0.5) == (F.col("quality") == 1), "lang"))


@query(f"""WITH c AS (SELECT sum(CASE WHEN p AND y THEN 1 ELSE 0 END)::DOUBLE AS tp, sum(CASE WHEN NOT p AND NOT y THEN 1 ELSE 0 END)::DOUBLE AS tn, sum(CASE WHEN p AND NOT y THEN 1 ELSE 0 END)::DOUBLE AS fp, sum(CASE WHEN NOT p AND y THEN 1 ELSE 0 END)::DOUBLE AS fn
 FROM (SELECT score >= 0.5 AS p, quality = 1 AS y FROM ({LABELLED})))
SELECT round(CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) > 0 THEN (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) ELSE 0 END, 6) AS mcc FROM c""")
def mcc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scoring.mcc(labelled(spark, sf_dir).withColumn("p", (F.col("score") >= 0.5).cast("int")), "quality", "p"))


@query(f"""WITH s AS ({LABELLED}), t AS (SELECT DISTINCT score AS t FROM s UNION SELECT max(score) + 1 FROM s),
 c AS (SELECT t, sum(CASE WHEN score >= t THEN quality ELSE 0 END)::DOUBLE AS tp, sum(CASE WHEN score < t THEN 1 - quality ELSE 0 END)::DOUBLE AS tn, sum(CASE WHEN score >= t THEN 1 - quality ELSE 0 END)::DOUBLE AS fp, sum(CASE WHEN score < t THEN quality ELSE 0 END)::DOUBLE AS fn FROM t, s GROUP BY t),
 m AS (SELECT t, round(CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) > 0 THEN (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) ELSE 0 END, 12) AS mcc FROM c)
SELECT round(t, 6) AS threshold, round(mcc, 6) AS mcc FROM m ORDER BY m.mcc DESC, t LIMIT 1""")
def best_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scoring.best_threshold(labelled(spark, sf_dir), "quality", "score"))




@query(f"""WITH p AS (SELECT a.conv_id, a.turn, {NORM.format(c='a.text')} AS p, {NORM.format(c='b.text')} AS r FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
 x AS (SELECT conv_id, turn, unnest(string_split(p, ' ')) AS t FROM p), y AS (SELECT conv_id, turn, unnest(string_split(r, ' ')) AS t FROM p),
 cx AS (SELECT conv_id, turn, t, count(*) AS c FROM x WHERE t <> '' GROUP BY ALL), cy AS (SELECT conv_id, turn, t, count(*) AS c FROM y WHERE t <> '' GROUP BY ALL),
 m AS (SELECT conv_id, turn, sum(least(cx.c, cy.c)) AS common FROM cx JOIN cy USING (conv_id, turn, t) GROUP BY ALL),
 n AS (SELECT conv_id, turn, sum(c) AS n FROM (SELECT * FROM cx UNION ALL SELECT * FROM cy) GROUP BY ALL)
SELECT p.conv_id, p.turn, CASE WHEN p = r THEN 1.0 ELSE 0.0 END::DOUBLE AS exact, round(CASE WHEN n.n IS NULL THEN 1 ELSE 2 * coalesce(common, 0) / n.n END, 6) AS f1 FROM p LEFT JOIN m USING (conv_id, turn) LEFT JOIN n USING (conv_id, turn)""")
def token_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    later = rows.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reference"))
    return rounded(scoring.token_f1(rows.join(later, ["conv_id", "turn"]), ["conv_id", "turn"], "text", "reference"))


def matches_sql(tokens: str, orders: int) -> str:
    """Clipped common n-grams by role and order of the sides t and u, with the totals of both."""
    grams = "unnest(list_transform(range(1, len({s}) - n + 2), lambda i: array_to_string({s}[i:i + n - 1], ' ')))"
    side = lambda s, k: f"SELECT i, role, n, {grams.format(s=s)} AS g, {k} AS s FROM k, (SELECT unnest(range(1, {orders + 1})) AS n) WHERE len({s}) >= n"
    return f"""SELECT role, n, sum(least(x, y)) AS m, sum(x) AS tx, sum(y) AS ty FROM (SELECT role, i, n, g, count(*) FILTER (s = 1) AS x, count(*) FILTER (s = 2) AS y FROM
 (WITH k AS (SELECT i, role, {tokens.replace("text", "t")} AS x, {tokens.replace("text", "u")} AS y FROM z) {side("x", 1)} UNION ALL {side("y", 2)}) GROUP BY ALL) GROUP BY ALL"""


LETTERS = r"list_filter(string_split(regexp_replace(text, '\s+', '', 'g'), ''), lambda c: c <> '')"


@query(f"""WITH a AS (SELECT row_number() OVER () AS i, x.role, x.text AS t, y.text AS u FROM conversations x JOIN conversations y ON y.conv_id = x.conv_id AND y.turn = x.turn + 1), z AS (SELECT * FROM a UNION ALL SELECT i, 'all', t, u FROM a),
 b AS ({matches_sql(WORDS, 4)}), c AS ({matches_sql(LETTERS, 6)}), l AS (SELECT role, sum(len({WORDS.replace("text", "t")})) AS h, sum(len({WORDS.replace("text", "u")})) AS r FROM z GROUP BY role),
 q AS (SELECT role, avg(CASE WHEN m > 0 THEN ln(m / tx) END) AS mean, count(*) FILTER (m > 0) AS orders FROM b GROUP BY role),
 f AS (SELECT role, 100 * sum(CASE WHEN m > 0 THEN 5 * (m / tx) * (m / ty) / (4 * (m / tx) + m / ty) ELSE 0 END) / 6 AS chrf FROM c GROUP BY role)
SELECT l.role, round(CASE WHEN orders = 4 THEN 100 * CASE WHEN h >= r THEN 1 ELSE exp(1 - r / h) END * exp(mean) ELSE 0 END, 6) AS bleu, round(chrf, 6) AS chrf FROM l JOIN q ON q.role = l.role JOIN f ON f.role = l.role""")
def bleu_chrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    later = rows.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reference"))
    pairs = rows.join(later, ["conv_id", "turn"]).select("role", "text", "reference")
    words = lambda c: tx.words(F.col(c))
    return rounded(scoring.bleu(pairs, "role", words("text"), words("reference"), overall="all").join(scoring.chrf(pairs, "role", F.col("text"), F.col("reference"), overall="all"), "role"))


#: Four tokenizers as columns of counts, for tables across tokenizers.
KINDS = {"byte": "octet_length(encode(text))", "char": "length(text)", "word": SOLID, "pretoken": f"len({TOKENS})"}
MATRIX = " UNION ALL ".join(f"SELECT '{k}' AS tokenizer, x.lang, sum(x.n) / sum(a.n) AS parity FROM (SELECT *, {e} AS n FROM ({GROUPS})) x JOIN (SELECT *, {e} AS n FROM ({GROUPS})) a ON a.group_id = x.group_id AND a.lang = 'en' GROUP BY x.lang" for k, e in KINDS.items())
BOARD = f"SELECT tokenizer, max(parity) / min(parity) AS spread FROM ({MATRIX}) GROUP BY tokenizer"


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token parity of every tokenizer and language, from one pass over the groups."""
    t = F.col("text")
    rows = parallel_groups(spark, sf_dir).select("group_id", "lang", F.octet_length(t).alias("byte"), F.length(t).alias("char"), tx.word_count(t).alias("word"), F.size(tx.pretokens(t)).alias("pretoken"))
    both = groups.with_anchor(rows, "en", list(KINDS)).filter("anchor_byte is not null")
    per = both.groupBy("lang").agg(*[(F.sum(k) / F.sum(f"anchor_{k}")).alias(k) for k in KINDS])
    return per.unpivot(["lang"], list(KINDS), "tokenizer", "parity")


def board(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix(spark, sf_dir).groupBy("tokenizer").agg((F.max("parity") / F.min("parity")).alias("spread"))


@query(f"SELECT tokenizer, round(spread, 6) AS spread, row_number() OVER (ORDER BY round(spread, 9), tokenizer) - 1 AS idx FROM ({BOARD})")
def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(results.leaderboard(board(spark, sf_dir).withColumn("spread", F.round("spread", 9))))


@query(f"""WITH p AS (SELECT tokenizer, lang, round(parity, 9) AS parity FROM ({MATRIX})), w AS (SELECT lang FROM p GROUP BY lang ORDER BY max(parity) DESC, lang LIMIT 3), c AS (SELECT p.*, sqrt(greatest(max(parity) OVER () - 1, 0)) AS s FROM p JOIN w USING (lang))
SELECT tokenizer, lang, round(parity, 6) AS parity, CASE WHEN s > 0 THEN least(39, floor(sqrt(greatest(parity - 1, 0)) / s * 40)) ELSE 0 END::BIGINT AS bucket FROM c""")
def heatmap_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(results.heat_cells(matrix(spark, sf_dir).withColumn("parity", F.round("parity", 9)), 3).select("tokenizer", "lang", "parity", "bucket"))


LEVELS = [("en", 5), ("fr", 4), ("de", 4), ("es", 3)]


@query(f"WITH l(lang, level) AS (VALUES {', '.join(map(str, LEVELS))}) SELECT tokenizer, level::BIGINT AS level, round(avg(parity), 6) AS mean_parity, count(*) AS n FROM ({MATRIX}) JOIN l USING (lang) GROUP BY GROUPING SETS ((tokenizer, level), (level))")
def resource_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(results.resource_levels(matrix(spark, sf_dir), spark.createDataFrame(LEVELS, "lang string, level int")))


@query(f"SELECT tokenizer, lang, round(1.3 * 1000000 * parity * 3.0 / 1e6, 6) AS cost FROM ({MATRIX})")
def api_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(results.api_cost(matrix(spark, sf_dir), F.lit(1.3), 1_000_000, 3.0).select("tokenizer", "lang", "cost"))


@query(f"""WITH r AS (SELECT tokenizer, 0 AS file_idx, spread FROM ({BOARD}) UNION ALL SELECT tokenizer, 1, spread * 2 FROM ({BOARD}) WHERE tokenizer <> 'byte')
SELECT tokenizer, round(spread, 6) AS spread FROM (SELECT *, row_number() OVER (PARTITION BY tokenizer ORDER BY file_idx DESC) AS i FROM r) WHERE i = 1""")
def results_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = board(spark, sf_dir)
    two = b.withColumn("file_idx", F.lit(0)).unionByName(b.filter("tokenizer != 'byte'").select("tokenizer", (F.col("spread") * 2).alias("spread"), F.lit(1).alias("file_idx")))
    return rounded(results.merged(two).select("tokenizer", "spread"))


@query(f"SELECT 'eval/parity/' || tokenizer || ':' || lang AS metric, round(parity, 6) AS value FROM ({MATRIX})")
def metric_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(results.as_metrics(matrix(spark, sf_dir).withColumn("k", F.concat_ws(":", "tokenizer", "lang")), "k", "eval", ["parity"]))


@query(f"""WITH c AS ({COUNTED}), p AS ({parity_sql('n_bytes')}), v AS (SELECT lang, stddev_pop(n_bytes) / avg(n_bytes) AS cv FROM c GROUP BY lang), a AS (SELECT lang, greatest(0.05, least(0.9, 0.25 / parity)) AS alpha, cv FROM p JOIN v USING (lang))
SELECT lang, round(alpha, 6) AS alpha, round(least(alpha, greatest(0.02, alpha - alpha * cv)), 6) AS beta FROM a""")
def rate_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.rate_band(counted_groups(spark, sf_dir), "en"))


@query("SELECT step, round(CASE WHEN step < 10 THEN step / 10.0 ELSE 0.5 * (1 + cos(pi() * least(1.0, (step - 10) / 90.0))) END, 6) AS factor FROM (SELECT unnest(range(120)) AS step)")
def lr_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(spark.range(120).select(F.col("id").alias("step"), metrics.rate_factor(F.col("id"), 10, 100).alias("factor")))


#: A bare code, one with a script, with a region, with a script and a variant, a long one, and two that are none.
CODES = ["de", "deu_Latn", "pt-BR", "zh-Hant", "ru_Cyrl_west1", "kor_Hang", "qqq", "7x", "_"]
NAMES = {"deu": "German", "por": "Portuguese", "zho": "Chinese", "rus": "Russian (individual language)"}
ALPHA3_SQL = f"""CASE WHEN regexp_full_match(code, '[A-Za-z]{{2}}([_-].*)?') THEN coalesce(element_at(MAP {{{", ".join(f"'{k}': '{v}'" for k, v in tx.ALPHA3.items())}}}, lower(code[1:2]))[1], code)
 WHEN regexp_full_match(code, '[A-Za-z]{{3}}([_-].*)?') THEN lower(code[1:3]) ELSE code END"""


@query(f"""WITH c AS (SELECT code, {ALPHA3_SQL} AS alpha3 FROM (VALUES {', '.join(f"('{c}')" for c in CODES)}) t(code))
SELECT code, split_part(code, '_', 1) AS short, CASE WHEN contains(code, '_') THEN substr(code, instr(code, '_') + 1) END AS script_first, CASE WHEN contains(code, '_') THEN list_last(string_split(code, '_')) END AS script_last, alpha3,
 coalesce(replace(element_at(MAP {{{", ".join(f"'{k}': '{v}'" for k, v in NAMES.items())}}}, alpha3)[1], ' (individual language)', ''), code) AS name,
 CASE WHEN list_last(string_split(code, '_')) IN ('Latn', 'Cyrl') THEN list_last(string_split(code, '_')) ELSE 'Latn' END AS script FROM c""")
def lang_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("code")
    rows = spark.createDataFrame([(x,) for x in CODES], "code string")
    return rows.select(
        "code", tx.short_code(c).alias("short"), tx.script_first(c).alias("script_first"), tx.script_last(c).alias("script_last"), tx.alpha3(c).alias("alpha3"),
        tx.display_name(c, NAMES).alias("name"), tx.script_hint(c, ["Cyrl", "Latn"]).alias("script"),
    )


@query("""WITH t AS (SELECT n_name, r_name, r_regionkey FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT n_name AS name, CASE WHEN r_regionkey = 0 THEN 5 ELSE r_regionkey END::BIGINT AS level FROM t""")
def taxonomy_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    taxonomy = table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("level")).unionByName(spark.createDataFrame([("manual", 5)], "name string, level int"))
    aliases = nation.filter("r_regionkey = 0").select(F.col("n_name").alias("alias"), F.lit("manual").alias("target"))
    names = nation.select(F.col("n_name").alias("name"), "r_name")
    got = groups.cascade(names, "name", F.array(F.lit("nowhere"), F.col("r_name")), taxonomy, aliases)
    return rounded(got)


@query("SELECT lang, CASE WHEN t IS NULL THEN 'dev' WHEN d IS NULL THEN 'train' ELSE 'both' END AS place FROM (SELECT DISTINCT lang, 1 AS t FROM documents WHERE doc_id < 50) FULL JOIN (SELECT DISTINCT lang, 1 AS d FROM documents WHERE doc_id >= 50) USING (lang)")
def language_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs(spark, sf_dir)
    return groups.language_overlap(rows.filter("doc_id < 50"), rows.filter("doc_id >= 50"))


@query("SELECT round(100.0 * count(l.doc_id) / count(*), 6) AS percent FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)")
def run_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(results.progress(docs(spark, sf_dir), table(spark, sf_dir, "labels"), ["doc_id"]))


@query("SELECT d.doc_id FROM documents d ANTI JOIN labels l USING (doc_id)")
def resume_remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.remaining(docs(spark, sf_dir), table(spark, sf_dir, "labels"), ["doc_id"]).select("doc_id")


@query()
def boundary_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    import re

    pattern = re.compile(rb"\s*\S+|\s+")
    return rounded(stability.by_lang(docs(spark, sf_dir), "doc_id", pattern.findall, samples=15))


@query(f"SELECT count(*) AS kept FROM (SELECT DISTINCT {KEY} FROM documents)")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch = table(spark, sf_dir, "documents")
    stream = streams.read_stream(spark, f"{sf_dir}/documents.parquet", batch.schema).select("doc_id", "text")
    return streams.run_available(streams.unique_texts(stream).select("key")).agg(F.count(F.lit(1)).alias("kept"))


@query(f"SELECT lang, count(*) AS docs, sum(len({TOKENS}))::BIGINT AS tokens, sum({BYTES})::BIGINT AS bytes FROM documents GROUP BY lang")
def stream_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch = table(spark, sf_dir, "documents")
    stream = streams.read_stream(spark, f"{sf_dir}/documents.parquet", batch.schema)
    return streams.run_available(streams.token_counts(stream), "complete")


@query("SELECT time_bucket(INTERVAL '1 day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch = table(spark, sf_dir, "events")
    stream = streams.read_stream(spark, f"{sf_dir}/events.parquet", batch.schema).withColumn("ts", F.col("ts").cast("timestamp"))
    return streams.run_available(streams.windowed(stream, "ts", "1 day", "400 days", "event_type", "value"), "complete").withColumn("total", F.round("total", 4))
