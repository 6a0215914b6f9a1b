"""The thin queries op1 to op10 and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm import bpe, chat, hnsw, minhash, mixing, pii, quality, sketches, substrings, warc
from lexiloom.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def token_digests(documents: DataFrame) -> DataFrame:
    """Encodes and decodes whole texts; digests of the decimal ids and of the decoded bytes."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.encode(documents, path, public_tokenizers.PATTERN, decoded=True).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op1_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"))


@query
def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query
def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.group(table(spark, sf_dir, "documents"))


@query
def op5_packaged_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write(table(spark, sf_dir, "pages"))
    return warc.read(archives, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op6_iblt_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.compare(sketches.edited(table(spark, sf_dir, "documents")))


@query
def op7_embedding_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.group(table(spark, sf_dir, "embeddings"))


@query
def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame([(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")], rows.schema)
    return chat.digests(chat.read(chat.write(rows.unionByName(planted))))


@query
def op9_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


@query
def op10_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.find(table(spark, sf_dir, "documents")))


_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_REACH = """reach(v, u) AS (SELECT v, v FROM verts UNION SELECT r.v, l.b FROM reach r JOIN links l ON l.a = r.u),
 comp AS (SELECT v, min(u) AS component_id FROM reach GROUP BY v)"""

ORACLE_SQL["op3_mix_sources"] = f"""WITH d AS (SELECT doc_id, source, len({_WORDS.format("coalesce(text, '')")})::BIGINT AS size, md5('17:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS k FROM documents),
 s AS (SELECT source, sum(size)::BIGINT AS source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS w FROM d GROUP BY source),
 l AS (SELECT *, 3.0::DOUBLE * source_size AS cap, (sum(source_size) OVER () - coalesce(sum(3.0::DOUBLE * source_size) OVER (ORDER BY 3.0::DOUBLE * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY 3.0::DOUBLE * source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s),
 f AS (SELECT *, arg_min(level, cap / w) FILTER (cap > level * w) OVER () AS final FROM l),
 t AS (SELECT source, source_size, CASE WHEN cap <= level * w OR final IS NULL THEN cap ELSE final * w END AS target FROM f),
 p AS (SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target + 1e-6)::BIGINT AS b, sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id ROWS UNBOUNDED PRECEDING) - d.size AS before FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source),
 r AS (SELECT *, CASE WHEN source_size > 0 THEN least(b // source_size, 3) ELSE 0 END AS rounds FROM p)
SELECT doc_id, size, source_size, target, (rounds * size + greatest(0, least(size, b - rounds * source_size - before)))::BIGINT AS taken FROM r"""

ORACLE_SQL["op4_near_duplicates"] = f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(f"coalesce({_LOWER}, '')")} AS ws FROM documents),
 s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 4 THEN list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE []::VARCHAR[] END) AS g FROM w),
 n AS (SELECT w.doc_id, count(g) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY w.doc_id),
 c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
 verts AS (SELECT doc_id AS v FROM documents),
 links AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 80 * (na.n + nb.n - i)), {_REACH}
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN comp ON v = doc_id"""

ORACLE_SQL["op5_packaged_warc"] = """WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS n, coalesce(html, '') AS h FROM pages),
 k AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY h) ELSE page_id END AS keep FROM p)
SELECT page_id, n AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN keep = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN keep <> page_id THEN keep END AS refers_to FROM k"""

ORACLE_SQL["op7_embedding_duplicates"] = f"""WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings), verts AS (SELECT vec_id AS v FROM e),
 links AS (SELECT p.vec_id AS a, q.vec_id AS b FROM e p JOIN e q ON p.vec_id <> q.vec_id AND list_cosine_similarity(p.x, q.x) >= 0.95), {_REACH}
SELECT v AS vec_id, (SELECT count(*) FROM links WHERE a = v) AS n_links, component_id, v = component_id AS kept FROM comp"""

ORACLE_SQL["op8_chat_format"] = r"""WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
 g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn) AS turns, coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '') AS loss,
  sum(length(role) + 24 + length(regexp_replace(text, '([<\[])(\\*)(\|im_start\|>|\|im_end\|>|INST\]|/INST\]|s>|/s>)', '\1#\2\3', 'g')))::BIGINT AS formatted_chars FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g"""

ORACLE_SQL["op9_recompression"] = f"""WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
 x AS (SELECT doc_id, i, md5(array_to_string(ws[i:i+34], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35)),
 r AS (SELECT doc_id, i FROM x WHERE h IN (SELECT h FROM x GROUP BY h HAVING count(*) > 1)),
 c AS (SELECT DISTINCT doc_id, i + k AS p FROM r, (SELECT unnest(range(35)) AS k)),
 t AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
 k AS (SELECT t.doc_id, count(*) AS n, count(c.p) AS gone, coalesce(string_agg(word, ' ' ORDER BY t.p) FILTER (c.p IS NULL), '') AS kept FROM t LEFT JOIN c ON c.doc_id = t.doc_id AND c.p = t.p GROUP BY t.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(gone, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k ON k.doc_id = w.doc_id"""
