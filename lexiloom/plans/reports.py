"""More queries: panels, reports across tokenizers, examples of benchmarks, id spaces and hooks, with their SQL."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions import text as tx
from lexiloom.functions import udtfs
from lexiloom.operators import adapter, bpe, contamination, groups, metrics, ordering, prep, results, scoring, stats, vocab
from lexiloom.operators.frames import numbered, shared_folder
from lexiloom.plans.catalogue import BOARD, BYTES, COUNTED, CUT_TOKENS, FREQ, GROUPS, MANIFEST, MATRIX, PREP, RENYI, SHINGLED, SOLID, TOKENS, TOPK, board, contamination_hits, counted_groups, docs, freq, matrix, parallel_groups, parity_sql, query, rounded, spread_out, table
from lexiloom.plans.catalogue import BENCH as BENCH_SHINGLES
from lexiloom.sources import readers
from lexiloom.streaming import streams

PRETOKEN = re.compile(rb"[ \t\n\x0b\f\r]*[^ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+")

MIXED = "CASE WHEN doc_id % 2 = 1 THEN replace(text, 'é', 'e' || chr(769)) ELSE text END"
NFC_WORDS = rf"regexp_extract_all(lower(nfc_normalize({MIXED})), '[\p{{L}}\p{{N}}_]+')"


@query(f"SELECT doc_id, len({NFC_WORDS})::BIGINT AS n_words, md5(array_to_string({NFC_WORDS}, ' ')) AS digest FROM documents")
def composed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = F.when(F.col("doc_id") % 2 == 1, F.replace("text", F.lit("é"), F.lit("é"))).otherwise(F.col("text"))
    rows = spread_out(docs(spark, sf_dir)).withColumn("ws", tx.composed_words(mixed))
    return rows.select("doc_id", F.size("ws").cast("long").alias("n_words"), F.md5(F.array_join("ws", " ").cast("binary")).alias("digest"))


NAMES = ["Northern Ruščuk (macro)", "old-style Ælfric", "D’Arvéñ'a", "Standard", "Greater  Upper Lümn", "Kin"]
QUALIFIED = ", ".join(f"'{q}'" for q in tx.QUALIFIERS)


@query(f"""WITH n AS (SELECT name, trim(regexp_replace(lower(name), '\\(.*?\\)', '', 'g')) AS low FROM (VALUES {", ".join("('" + n.replace("'", "''") + "')" for n in NAMES)}) t(name)),
 p AS (SELECT name, low, trim(regexp_replace(strip_accents(replace(replace(replace(replace(low, 'ʼ', ''''), '’', ''''), '''', ''), '-', ' ')), '\\s+', ' ', 'g')) AS plain FROM n),
 s AS (SELECT *, string_split(plain, ' ') AS w FROM p),
 c AS (SELECT name, list_concat([low, plain], CASE WHEN len(w) > 1 THEN list_concat(CASE WHEN w[1] IN ({QUALIFIED}) THEN [array_to_string(w[2:], ' ')] ELSE []::VARCHAR[] END, [w[len(w)], w[1]]) ELSE []::VARCHAR[] END) AS c FROM s),
 u AS (SELECT name, unnest(c) AS candidate, unnest(range(len(c))) AS i FROM c), f AS (SELECT name, candidate, min(i) AS i FROM u GROUP BY ALL)
SELECT name, candidate, row_number() OVER (PARTITION BY name ORDER BY i) - 1 AS pos FROM f""")
def name_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(n,) for n in NAMES], "name string")
    return rounded(rows.select("name", F.posexplode(tx.name_candidates(F.col("name"))).alias("pos", "candidate")))


BARE = r"regexp_replace(regexp_replace(text, '\s+$', ''), '\.$', '')"


@query(rf"""WITH e AS (SELECT 'entailment' AS kind, role AS lang, conv_id, turn, text || chr(10) || 'Question: ' || role || ' True, False, or Neither?' || chr(10) || 'Answer:' AS context, ' True| False| Neither' AS choices FROM conversations UNION ALL
 SELECT 'cause', role, conv_id, turn, {BARE} || CASE WHEN turn % 2 = 0 THEN ' because' ELSE ' so' END, ' ' || lower(left(role, 1)) || substr(role, 2) || '| ' || lower(left(upper(role), 1)) || substr(upper(role), 2) FROM conversations)
SELECT kind, lang, row_number() OVER (PARTITION BY kind, lang ORDER BY conv_id * 1000 + turn) AS turn, md5(context) AS context, choices FROM e""")
def choice_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("n"), F.col("role").alias("lang"), F.col("text").alias("premise"), F.col("role").alias("hypothesis"), F.lit(0).alias("label"), "turn")
    cause = rows.select("n", "lang", "premise", F.col("hypothesis").alias("choice1"), F.upper("hypothesis").alias("choice2"), F.when(F.col("turn") % 2 == 0, "cause").otherwise("effect").alias("question"), "label")
    got = readers.entailment_examples(rows.drop("turn"), "n").withColumn("kind", F.lit("entailment")).unionByName(readers.cause_examples(cause, "n").withColumn("kind", F.lit("cause")))
    return got.select("kind", "lang", "turn", F.md5("context").alias("context"), F.array_join("choices", "|").alias("choices"))


@query("""SELECT 'pair' AS kind, 'p' || (item_id % 3) AS lang, md5('') AS context, md5(text || '|' || reverse(text)) AS answers, row_number() OVER (PARTITION BY item_id % 3 ORDER BY item_id) AS turn FROM benchmark
UNION ALL SELECT 'qa', 'en', md5(text || chr(10) || 'Question: ' || item_id || chr(10) || 'Answer:'), md5('! ' || text || '|' || text), item_id FROM benchmark""")
def benchmark_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "benchmark")
    pairs = readers.minimal_pair_examples(rows.select("item_id", F.concat(F.lit("p"), (F.col("item_id") % 3).cast("string")).alias("paradigm"), F.col("text").alias("sentence_good"), F.reverse("text").alias("sentence_bad")), "item_id")
    pairs = pairs.select(F.lit("pair").alias("kind"), "lang", F.md5("context").alias("context"), F.md5(F.array_join("choices", "|")).alias("answers"), F.col("turn").cast("long").alias("turn"))
    asked = readers.qa_examples(rows.select(F.col("text").alias("context"), F.col("item_id").cast("string").alias("question"), F.array(F.concat(F.lit("! "), "text"), F.col("text")).alias("answers")))
    return pairs.unionByName(asked.select(F.lit("qa").alias("kind"), "lang", F.md5("prompt").alias("context"), F.md5(F.array_join("answers", "|")).alias("answers"), F.col("question").cast("long").alias("turn")))


PAIRS = [("en", "fr"), ("de", "es")]


@query(f"""WITH g AS ({GROUPS}) SELECT s.lang AS source_lang, t.lang AS target_lang, row_number() OVER (PARTITION BY s.lang, t.lang ORDER BY s.group_id) AS turn, md5(s.text) AS source, md5(t.text) AS reference
FROM (VALUES {", ".join(map(str, PAIRS))}) p(a, b) JOIN g s ON s.lang = p.a JOIN g t ON t.lang = p.b AND t.group_id = s.group_id""")
def translation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = readers.translation_examples(parallel_groups(spark, sf_dir), PAIRS)
    return got.select("source_lang", "target_lang", "turn", F.md5("source_text").alias("source"), F.md5("reference_text").alias("reference"))


PANEL_LANGS = "(" + ", ".join(f"'{k}'" for k in sorted({x for pair in MANIFEST for x in pair})) + ")"
PER_LANG = f"SELECT lang, avg(CASE WHEN n_tokens > 0 THEN n_bytes / n_tokens ELSE 0 END) AS compression, sum(n_tokens) / sum(n_words) AS fertility FROM ({COUNTED}) WHERE lang IN {PANEL_LANGS} GROUP BY lang"


def panel(spark: SparkSession, sf_dir: str, with_freq: bool) -> DataFrame:
    rows = metrics.require_anchors(counted_groups(spark, sf_dir).filter("lang != 'xx'"), ["en", "fr"]) if with_freq else counted_groups(spark, sf_dir)
    return metrics.panel(rows, spark.createDataFrame(MANIFEST, "lang string, anchor string"), freq(spark, sf_dir) if with_freq else None)


@query(f"SELECT p.lang, round(compression, 6) AS compression, round(fertility, 6) AS fertility, round(renyi, 6) AS renyi FROM ({PER_LANG}) p JOIN ({RENYI}) r ON r.lang = p.lang")
def panel_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(panel(spark, sf_dir, True))


@query(f"SELECT round(max(fertility) / min(fertility), 6) AS fertility_spread, round(max(compression) / min(compression), 6) AS compression_spread FROM ({PER_LANG})")
def panel_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.morphology_spread(panel(spark, sf_dir, False)))


@query(f"""WITH c AS (SELECT doc_id, lang, {BYTES} AS n_bytes, {SOLID} AS n_words, CASE WHEN doc_id % 7 > 0 THEN len({TOKENS}) END AS n_tokens FROM documents)
SELECT lang, count(*) AS calls, sum(CASE WHEN n_tokens IS NULL THEN 1 ELSE 0 END)::BIGINT AS failed, round(avg(n_bytes / n_tokens), 6) AS compression, round(sum(CASE WHEN n_tokens IS NOT NULL THEN n_tokens END) / sum(CASE WHEN n_tokens IS NOT NULL THEN n_words END), 6) AS fertility FROM c GROUP BY lang""")
def panel_counts_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = metrics.counts(spread_out(docs(spark, sf_dir)), F.when(F.col("doc_id") % 7 > 0, F.size(tx.pretokens(F.col("text")))))
    good, tally = metrics.counted_or_failed(calls)
    return rounded(metrics.by_lang(good).select("lang", "compression", "fertility").join(tally, "lang"))


@query(f"SELECT item_id, count(*) AS n, md5(string_agg(g, '|' ORDER BY g)) AS shingles FROM (SELECT DISTINCT item_id, g FROM ({BENCH_SHINGLES}) JOIN (SELECT DISTINCT g FROM ({SHINGLED})) USING (g)) GROUP BY item_id")
def contamination_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = contamination.matched(contamination_hits(spark, sf_dir))
    return got.select("item_id", F.size("shingles").cast("long").alias("n"), F.md5(F.array_join("shingles", "|")).alias("shingles"))


@query("""SELECT s_suppkey, s_nationkey, round(z, 6) AS z FROM (SELECT *, (s_acctbal - avg(s_acctbal) OVER w) / stddev_pop(s_acctbal) OVER w AS z, count(*) OVER w AS n, stddev_pop(s_acctbal) OVER w AS s FROM supplier WINDOW w AS (PARTITION BY s_nationkey))
WHERE n >= 2 AND s > 0 ORDER BY z, s_suppkey, s_nationkey LIMIT 10""")
def family_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.anomalies(table(spark, sf_dir, "supplier"), "s_acctbal", ["s_nationkey"], "s_suppkey").select("s_suppkey", "s_nationkey", "z"))


@query()
def correlation_signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p-values come from Student's distribution, which SQL doesn't have; rho itself is in ``spearman``."""
    return stats.sign_counts(stats.correlations_by(table(spark, sf_dir, "part"), "p_brand", "p_size", "p_retailprice"))


SIZES = [("byte", 256), ("char", 5000), ("word", 50000), ("pretoken", None)]


@query(f"""WITH b AS (SELECT tokenizer, round(spread, 9) AS spread FROM ({BOARD})), s AS (SELECT b.*, n FROM b JOIN (VALUES ('byte', 256), ('char', 5000), ('word', 50000)) v(t, n) ON t = tokenizer),
 r AS (SELECT rank() OVER (ORDER BY spread) + (count(*) OVER (PARTITION BY spread) - 1) / 2.0 AS x, rank() OVER (ORDER BY n) AS y FROM s), c AS (SELECT corr(x, y) AS rho FROM r)
SELECT round(min(spread), 6) AS least, round(max(spread), 6) AS greatest, round(max(spread) / min(spread), 6) AS factor, round(any_value(rho), 6) AS rho, 3 AS sized,
 CASE WHEN abs(any_value(rho)) >= 0.7 THEN 'strong' WHEN abs(any_value(rho)) >= 0.4 THEN 'moderate' WHEN abs(any_value(rho)) >= 0.2 THEN 'weak' ELSE 'negligible' END AS strength FROM b, c""")
def spread_by_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = board(spark, sf_dir).withColumn("spread", F.round("spread", 9))
    return rounded(stats.spread_range(b.join(spark.createDataFrame(SIZES, "tokenizer string, vocab_size long"), "tokenizer", "left")))


@query(f"SELECT tokenizer, round(spread, 6) AS spread, n AS vocab_size FROM ({BOARD}) JOIN (VALUES ('byte', 256), ('char', 5000), ('word', 50000)) v(t, n) ON t = tokenizer")
def known_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = groups.known_sizes(board(spark, sf_dir), spark.createDataFrame(SIZES, "tokenizer string, vocab_size long"))
    return rounded(got.select("tokenizer", "spread", "vocab_size"))


@query("""WITH m AS (SELECT quantile_cont(p_size, 0.5) AS mx, quantile_cont(p_retailprice, 0.5) AS my FROM part)
SELECT * FROM (SELECT p_partkey, 'high-high' AS quadrant, row_number() OVER (ORDER BY p_size DESC, p_retailprice DESC, p_partkey) AS place FROM part, m WHERE p_size > mx AND p_retailprice > my
UNION ALL SELECT p_partkey, 'low-low', row_number() OVER (ORDER BY p_size, p_retailprice, p_partkey) FROM part, m WHERE p_size <= mx AND p_retailprice <= my) WHERE place <= 5""")
def quadrant_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.outlier_lists(table(spark, sf_dir, "part"), "p_partkey", "p_size", "p_retailprice").select("p_partkey", "quadrant", "place"))


@query("""WITH q AS (SELECT o_orderpriority, quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.75) AS q3 FROM orders GROUP BY 1)
SELECT o_orderkey FROM orders JOIN q USING (o_orderpriority) WHERE NOT o_totalprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)""")
def box_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.box_outliers(table(spark, sf_dir, "orders"), "o_totalprice", ["o_orderpriority"]).select("o_orderkey")


#: Names as results carry them, one of each family that a rule names.
FULL_NAMES = {"byte": "tiktoken:bytes_base", "char": "meta-llama/Chars", "word": "our-words", "pretoken": "org/pretokens"}
FAMILIES = {"byte": "OpenAI/tiktoken", "char": "Meta/Llama", "word": "This work", "pretoken": "Other"}
SHORT = {"byte": "tk:bytes_base", "char": "Chars", "word": "our-words", "pretoken": "pretokens"}


def case_sql(values: dict[str, str]) -> str:
    return "CASE tokenizer " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " END"


def named(df: DataFrame) -> DataFrame:
    table_ = F.create_map(*[F.lit(x) for pair in FULL_NAMES.items() for x in pair])
    return df.withColumn("tokenizer", F.element_at(table_, F.col("tokenizer")))


@query(f"SELECT {case_sql(FAMILIES)} AS family, lang, {case_sql(SHORT)} AS short, round(avg(parity), 6) AS mean, count(*) AS n FROM ({MATRIX}) GROUP BY ALL")
def family_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = named(matrix(spark, sf_dir)).withColumn("short", results.short_name(F.col("tokenizer")))
    return rounded(results.family_means(rows, results.family_of(F.col("tokenizer"), own=["our-words"]), keys=("lang", "short")))


@query(f"SELECT tokenizer, CASE WHEN tokenizer IN ('byte', 'word') THEN 'This work' ELSE 'Other' END AS family, row_number() OVER (ORDER BY round(spread, 9), tokenizer) - 1 AS idx FROM ({BOARD})")
def scoped_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(results.scoped_leaderboard(board(spark, sf_dir).withColumn("spread", F.round("spread", 9)), ["byte", "word"]).select("tokenizer", "family", "idx"))


@query(f"""WITH b AS (SELECT tokenizer, round(spread, 9) AS v, CASE WHEN tokenizer IN ('byte', 'char') THEN 'a' ELSE 'b' END AS family FROM ({BOARD})),
 s AS (SELECT family, count(*) AS n, min(v) AS best FROM b GROUP BY family), o AS (SELECT family, coalesce(sum(n + 1) OVER (ORDER BY best, family ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM s)
SELECT tokenizer, (start + row_number() OVER (PARTITION BY b.family ORDER BY v, tokenizer) - 1)::BIGINT AS position FROM b JOIN o ON o.family = b.family""")
def family_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = board(spark, sf_dir).withColumn("spread", F.round("spread", 9)).withColumn("family", F.when(F.col("tokenizer").isin("byte", "char"), "a").otherwise("b"))
    return rounded(results.family_layout(rows, "family", "spread").select("tokenizer", F.col("position").cast("long").alias("position")))


@query("""WITH s AS (SELECT lang, source AS file, count(*) AS n, min(doc_id) AS seen FROM documents GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, seen) AS i, count(*) OVER (PARTITION BY lang) - 1 AS alternatives FROM s)
SELECT lang, file, n AS entries, alternatives FROM r WHERE i = 1""")
def canonical_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.canonical_files(docs(spark, sf_dir).select("lang", F.col("source").alias("file"), F.col("doc_id").alias("first_seen")))


@query(f"SELECT * FROM (SELECT lang, span, cnt, row_number() OVER (PARTITION BY lang ORDER BY cnt DESC, span) AS place FROM ({FREQ.replace(TOKENS, "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')")}) WHERE length(span) >= 5) WHERE place <= 20")
def top_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = metrics.frequencies(spread_out(docs(spark, sf_dir)), tx.words(F.col("text")))
    return rounded(vocab.top_types(words, 20, 5))


@query(f"SELECT round(var_pop(renyi), 9) AS variance, arg_min(lang, renyi) AS min_lang, arg_max(lang, renyi) AS max_lang FROM ({RENYI})")
def renyi_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.extremes(metrics.renyi(freq(spark, sf_dir)), "renyi"), 9)


@query()
def plain_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A naive vocabulary of 300 entries on a drawn sample; the fit is compared with a plain loop in the tests."""
    return spark.createDataFrame([(bpe.plain_rate(docs(spark, sf_dir), "doc_id", 300, sample=60),)], "rate double")


@query(f"""WITH r AS (SELECT tokenizer, CASE WHEN tokenizer = 'char' THEN NULL ELSE spread END AS spread, 0 AS f FROM ({BOARD}) WHERE tokenizer <> 'word'), x(tokenizer) AS (VALUES ('word'), ('byte'), ('none'))
SELECT 'lacking' AS what, tokenizer FROM r WHERE spread IS NULL UNION ALL SELECT 'failed', tokenizer FROM x WHERE tokenizer NOT IN (SELECT tokenizer FROM r)""")
def results_lacking(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = board(spark, sf_dir).filter("tokenizer != 'word'")
    first = rows.filter("tokenizer != 'char'")
    later = rows.filter("tokenizer = 'char'").withColumn("spread", F.lit(None).cast("double"))
    merged = results.merged(results.same_shape([first, later]))
    failed = results.still_failed(spark.createDataFrame([("word",), ("byte",), ("none",)], "tokenizer string"), merged)
    return results.without_value(merged, "spread").select(F.lit("lacking").alias("what"), "tokenizer").union(failed.select(F.lit("failed"), "tokenizer"))


@query("SELECT * FROM (VALUES ('ours', 50000, 'declared', NULL), ('closed', -1, 'proprietary', NULL), ('open', 257, 'loaded', NULL), ('gone', -1, 'loaded', 'not there')) t(tokenizer, vocab_size, source, error)")
def vocabulary_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    def gone() -> int:
        raise OSError("not there")

    got = results.vocabulary_sizes(spark, {"ours": 50_000}, ["closed"], {"open": lambda: adapter.from_merges(bpe.Merges(), adapter.one_by_one(PRETOKEN.findall)).vocab_size, "gone": gone})
    return got.withColumn("vocab_size", F.coalesce("vocab_size", F.lit(-1)).cast("long"))


@query(f"SELECT lang, round(greatest(0.1, least(0.4, 0.3 * parity)), 6) AS target FROM ({parity_sql('n_bytes')})")
def lang_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.lang_targets(metrics.parity(counted_groups(spark, sf_dir), "en", "n_bytes"), 0.3, 0.1, 0.4))


@query("SELECT conv_id, string_agg(role || turn, ';;' ORDER BY turn) AS id FROM conversations GROUP BY conv_id")
def verse_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.col("turn").cast("string")).alias("v")))).alias("vs"))
    return rows.select("conv_id", tx.verse_id(F.col("vs.v")).alias("id"))


@query("""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lang ELSE CASE lang WHEN 'en' THEN 'eng_Latn' WHEN 'fr' THEN 'fra_Latn' ELSE lang END END AS raw FROM documents),
 n AS (SELECT raw, CASE raw WHEN 'en' THEN 'eng' WHEN 'fr' THEN 'fra' WHEN 'de' THEN 'deu' WHEN 'es' THEN 'spa' ELSE raw[1:3] END AS lang FROM d)
SELECT lang, string_agg(DISTINCT raw, ',' ORDER BY raw) AS codes, count(*) AS n FROM n GROUP BY lang""")
def language_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = F.when(F.col("lang") == "en", "eng_Latn").when(F.col("lang") == "fr", "fra_Latn").otherwise(F.col("lang"))
    rows = docs(spark, sf_dir).select(F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise(long).alias("lang"))
    return groups.raw_codes(groups.pooled_by_language(rows))


@query(f"SELECT id, md5(span) AS digest, octet_length(encode(span))::BIGINT AS n_shown FROM ({TOPK})")
def token_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible forms have a character per byte and give the bytes back."""
    shown = vocab.topk(freq(spark, sf_dir), 200).withColumn("shown", tx.token_string(F.col("span").cast("binary")))
    return rounded(shown.select("id", F.md5(tx.token_bytes(F.col("shown"))).alias("digest"), F.length("shown").alias("n_shown")))


@query("""WITH a AS (SELECT n_name AS code, 'g:' || n_nationkey AS s FROM nation WHERE n_nationkey % 2 = 0), b AS (SELECT n_name AS code, 'm:' || n_nationkey AS s FROM nation WHERE n_nationkey % 3 = 0), o AS (SELECT n_name AS code, 'own' AS s FROM nation WHERE n_nationkey % 5 = 0)
SELECT code, coalesce(o.s, concat_ws(',', a.s, b.s)) AS sources FROM a FULL JOIN b USING (code) FULL JOIN o USING (code)""")
def merged_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    part = lambda k, value: nation.filter(F.col("n_nationkey") % k == 0).select(F.col("n_name").alias("code"), value.alias("sources"))
    number = F.col("n_nationkey").cast("string")
    return groups.merged_sources(part(2, F.concat(F.lit("g:"), number)), part(3, F.concat(F.lit("m:"), number)), part(5, F.lit("own")))


@query("SELECT n_name AS name, CASE WHEN n_nationkey % 4 > 0 THEN lower(replace(n_name, ' ', '')) END AS file FROM nation")
def file_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("name"))
    files = wanted.filter("n_nationkey % 4 > 0").select(F.lower(F.replace("name", F.lit(" "), F.lit(""))).alias("name"))
    found, missing = readers.by_file_name(files, wanted.select("name"))
    return found.select("name", "file").union(missing.select("name", F.lit(None).cast("string")))


@query("SELECT * FROM (SELECT role, conv_id * 1000 + turn AS n, row_number() OVER (PARTITION BY role ORDER BY conv_id * 1000 + turn) AS place, md5(text) AS digest FROM conversations) WHERE place <= 2")
def first_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("role", (F.col("conv_id") * 1000 + F.col("turn")).alias("n"), F.md5("text").alias("digest"))
    return rounded(scoring.first_samples(rows, "role", "n", 2))


@query("SELECT 'step_' || (100 * s_suppkey) || '.pt' AS name, 100 * s_suppkey AS step, row_number() OVER (ORDER BY s_suppkey DESC) <= 3 AS kept FROM supplier")
def checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "supplier").select(F.concat(F.lit("step_"), (100 * F.col("s_suppkey")).cast("string"), F.lit(".pt")).alias("name"))
    return ordering.latest_checkpoints(names, "name", 3)


@query("""WITH e AS (SELECT value, (row_number() OVER (ORDER BY ts, event_id) - 1) // 20 AS w FROM events), a AS (SELECT w, sum(value) AS s, count(value) AS n FROM e GROUP BY w)
SELECT w AS "window", round(s / n, 4) AS mean, round(sum(s) OVER (ORDER BY w) / sum(n) OVER (ORDER BY w), 4) AS running FROM a""")
def step_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = numbered(table(spark, sf_dir, "events").select("ts", "event_id", "value"), ["ts", "event_id"], "step").withColumn("step", F.col("step") - 1)
    return rounded(streams.windows_by_step(rows, "step", "value", 20), 4)


#: Ids of a text in a space of 256 bytes and the longer spans of the vocabulary by rank.
SPAN_IDS = f"""WITH v AS (SELECT span, row_number() OVER (ORDER BY id) + 255 AS id FROM ({TOPK}) WHERE octet_length(encode(span)) > 1), t AS (SELECT doc_id, unnest({TOKENS}) AS span, unnest(range(len({TOKENS}))) AS i FROM documents),
 s AS (SELECT DISTINCT span FROM t), b AS (SELECT span, string_agg((('0x' || hex(encode(span))[2 * k + 1:2 * k + 2])::INT)::VARCHAR, ' ' ORDER BY k) AS ids, count(*) AS n FROM (SELECT span, unnest(range(octet_length(encode(span)))) AS k FROM s WHERE span NOT IN (SELECT span FROM v)) GROUP BY span),
 m AS (SELECT span, id::VARCHAR AS ids, 1 AS n FROM v UNION ALL SELECT span, ids, n FROM b)
SELECT doc_id, (sum(n) + 1)::BIGINT AS n_ids, md5(string_agg(ids, ' ' ORDER BY i) || ' ' || (256 + (SELECT count(*) FROM v))) AS ids, md5(string_agg(t.span, '' ORDER BY i)) AS decoded FROM t JOIN m ON m.span = t.span GROUP BY doc_id"""


def span_tokenizer(spark: SparkSession, sf_dir: str) -> adapter.Tokenizer:
    return adapter.from_spans(vocab.span_ids(vocab.topk(freq(spark, sf_dir), 200)), adapter.one_by_one(PRETOKEN.findall))


@query(SPAN_IDS)
def span_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = span_tokenizer(spark, sf_dir)
    rows = adapter.decoded(adapter.encoded(spread_out(docs(spark, sf_dir)).filter("length(text) > 0").drop("source"), tokenizer, end=True), tokenizer)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_ids"), F.md5(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids"), F.md5("decoded").alias("decoded"))


@query(f"""WITH p AS MATERIALIZED ({PREP}), v AS MATERIALIZED (SELECT span FROM ({TOPK})), t AS MATERIALIZED (SELECT unnest({CUT_TOKENS}) AS span FROM p),
 n AS (SELECT (sum(CASE WHEN v.span IS NULL THEN octet_length(encode(t.span)) ELSE 1 END) + (SELECT count(*) FROM p))::BIGINT AS total FROM t LEFT JOIN v ON v.span = t.span)
SELECT k AS shard_id, least(20000, total - 20000 * k) AS n_tokens, total FROM n, (SELECT unnest(range(100000)) AS k) WHERE 20000 * k < total""")
def prep_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes a prepared corpus as token shards with its metadata and reads both back."""
    tokenizer, options = span_tokenizer(spark, sf_dir), prep.PrepOptions(shard_size=20_000)
    result = prep.prepare(spread_out(docs(spark, sf_dir)), "doc_id", options=options, tokenizer=tokenizer)
    folder = f"{shared_folder(spark)}/lexiloom/tokens-{uuid.uuid4().hex}"
    meta = prep.write(result, "source", folder, tokenizer, options)
    shards = spark.read.parquet(f"{folder}/shards").groupBy("shard_id").agg(F.sum(F.size("ids")).alias("n_tokens"))
    return rounded(shards.crossJoin(F.broadcast(meta.select(F.col("tokens").alias("total")))).select(F.col("shard_id").cast("long").alias("shard_id"), "n_tokens", "total"))  # one row of metadata


@query(f"SELECT lang, sum(len({TOKENS}))::BIGINT AS tokens, count(*) AS texts FROM documents WHERE lang IN ('en', 'fr') GROUP BY lang")
def hooked_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tokenizer with functions for two languages; the others are left out."""
    tokenizer = adapter.from_spans([], adapter.by_language({"en": PRETOKEN.findall, "fr": PRETOKEN.findall}), ["en", "fr"])
    spans = adapter.with_spans(spread_out(docs(spark, sf_dir)), tokenizer)
    return spans.groupBy("lang").agg(F.sum(F.size("spans")).alias("tokens"), F.count(F.lit(1)).alias("texts"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 6 > 0 THEN octet_length(encode(n_name))::BIGINT ELSE -1 END AS n_tokens FROM nation")
def rate_limited_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts from a service that refuses some texts."""
    def count(text: str) -> int:
        if text.startswith("!"):
            raise OSError("refused")
        return len(text.encode())

    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.when(F.col("n_nationkey") % 6 > 0, F.col("n_name")).otherwise(F.concat(F.lit("!"), "n_name")).alias("text"))
    return streams.within_rate(rows, count, 1_000_000).select("n_nationkey", F.coalesce("n_tokens", F.lit(-1)).cast("long").alias("n_tokens"))


@query(f"SELECT doc_id, count(*) AS n_shingles, min(md5(g)) AS least_key FROM ({SHINGLED}) GROUP BY doc_id")
def sql_shingles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table function for SQL users."""
    udtfs.register(spark)
    docs(spark, sf_dir).createOrReplaceTempView("lexiloom_documents")
    return spark.sql("SELECT doc_id, count(*) AS n_shingles, min(md5(shingle)) AS least_key FROM lexiloom_documents, LATERAL shingles(text, 13) GROUP BY doc_id")
