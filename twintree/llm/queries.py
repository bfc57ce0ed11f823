"""The registered queries of this subpackage: each applies one operator, with its production parameters, to a whole table."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encode_documents
from .common import table
from .embedding_dedup import forest_links
from .jaccard_join import jaccard_components
from .mixing import mix
from .sharding import shard_documents
from .suffix_dedup import remove_repeats
from .surrogates import replace_entities
from .topk_search import top_k
from .toxicity import fit_toxicity, held_out, score_documents
from .url_filter import Rule, judge_urls

URL_RULES = [
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
]


def tokenizer_model(path: str | None = None) -> str:
    """JSON text of the tokenizer; path defaults to the public word-end BPE file that is installed."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return Path(path).read_text(encoding="utf-8")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 100 = 0"), k=10, scale=1024)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), length=400, keep_text=True).drop("kept")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), words=4, percent=85)


def op5_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_entities(table(spark, sf_dir, "documents"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest_links(table(spark, sf_dir, "embeddings"), threshold=0.93)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"), diagnose=True)
    return mixed.where("kept").select("doc_id", "lang", "source", "topic", "n_words", "inclusion")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return score_documents(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), tokenizer_model())


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), shards=24)


QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_topk_search": op2_topk_search,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_surrogates": op5_surrogates,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_mixing": op7_mixing,
    "op8_toxicity": op8_toxicity,
    "op9_bpe": op9_bpe,
    "op10_sharding": op10_sharding,
}

_URL_SQL = r"""
WITH cut AS (
  SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
), rules(rhost, rpath, action) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
)
SELECT p.page_id, p.host, p.path, max_by(r.rhost || r.rpath, length(r.rhost || r.rpath)) AS rule,
       coalesce(max_by(r.action, length(r.rhost || r.rpath)), 'allow') AS verdict
FROM parts p LEFT JOIN rules r ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath)
GROUP BY p.page_id, p.host, p.path
"""

_TOPK_SQL = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM whole q JOIN whole c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""

_JACCARD_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM words
), grams AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
), pairs AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, p.v FROM reach r JOIN pairs p ON r.other = p.u
)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(r.other) AS component_id FROM sets s JOIN reach r USING (doc_id) GROUP BY s.doc_id, s.s
"""

_SUFFIX_SQL = r"""
WITH raw AS MATERIALIZED (
  SELECT doc_id, text, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, ''))::BIGINT AS n FROM documents
), windows AS MATERIALIZED (
  SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 800)) AS m FROM (SELECT doc_id, h, unnest(range(n - 399)) AS i FROM raw WHERE n >= 400)
), repeated AS (
  SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM windows WHERE m IN (SELECT m FROM windows GROUP BY m HAVING count(*) > 1)
), runs AS (
  SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 400 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM repeated
), spans AS MATERIALIZED (
  SELECT doc_id, min(i) AS low, max(i) + 400 AS high FROM runs GROUP BY doc_id, r
), pieces AS (
  SELECT doc_id, coalesce(lag(high) OVER (PARTITION BY doc_id ORDER BY low), 0) AS a, low AS b FROM spans
  UNION ALL SELECT raw.doc_id, coalesce(max(high), 0), n FROM raw LEFT JOIN spans ON raw.doc_id = spans.doc_id GROUP BY raw.doc_id, n
), cut AS (
  SELECT p.doc_id, a, substr(h, 2 * a + 1, 2 * (b - a)) AS k FROM pieces p JOIN raw ON p.doc_id = raw.doc_id
), kept AS (
  SELECT doc_id, string_agg(k, '' ORDER BY a) AS k,
         string_agg(regexp_replace(regexp_replace(k, '^(?:[89AB][0-9A-F])+', ''), '(?:[CD][0-9A-F]|E[0-9A-F](?:[89AB][0-9A-F])?|F[0-9A-F](?:[89AB][0-9A-F]){0,2})$', ''), '' ORDER BY a) AS whole
  FROM cut GROUP BY doc_id
), sums AS (
  SELECT doc_id, sum(high - low)::BIGINT AS removed, count(*) AS spans FROM spans GROUP BY doc_id
)
SELECT r.doc_id, r.n AS n_bytes, coalesce(s.removed, 0)::BIGINT AS n_removed, coalesce(s.spans, 0)::BIGINT AS n_spans, sha256(unhex(k.k)) AS kept_sha256,
       CASE WHEN r.text IS NOT NULL THEN decode(unhex(k.whole)) END AS text
FROM raw r JOIN kept k ON r.doc_id = k.doc_id LEFT JOIN sums s ON r.doc_id = s.doc_id
"""

_FOREST_SQL = """
WITH RECURSIVE whole AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), pairs AS MATERIALIZED (
  SELECT a.vec_id AS u, b.vec_id AS v FROM whole a JOIN whole b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.93
), reach(vec_id, other) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, p.v FROM reach r JOIN pairs p ON r.other = p.u
), parts AS (
  SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id
)
SELECT p.vec_id, (SELECT count(*) FROM pairs WHERE u = p.vec_id)::BIGINT AS n_links, component_id, p.vec_id = component_id AS kept FROM parts p
"""

# Bytes are put into shards by the same binary search, one step of the walk (a shard) or of the search a row.
_SHARD_SQL = """
WITH RECURSIVE bytes(value) AS (SELECT unnest(range(256))),
table_steps(value, crc, k) AS (
  SELECT value, value::UBIGINT, 0 FROM bytes UNION ALL SELECT value, CASE WHEN crc & 1 = 1 THEN xor(crc >> 1, 3988292384::UBIGINT) ELSE crc >> 1 END, k + 1 FROM table_steps WHERE k < 8
), tables AS (SELECT list(crc ORDER BY value) AS t FROM table_steps WHERE k = 8),
sized AS MATERIALIZED (
  SELECT doc_id, text, (coalesce(strlen(text), 0) + 8)::BIGINT AS size, coalesce(sha256(text), 'null') AS digest FROM documents
), crcs AS MATERIALIZED (
  SELECT text, xor(list_reduce(list_transform(range(strlen(text)), lambda i: ('0x' || substr(hex(encode(text)), 2 * i + 1, 2))::UBIGINT), lambda c, b: xor(c >> 8, t[((xor(c, b) & 255) + 1)::BIGINT]), 4294967295::UBIGINT), 4294967295::UBIGINT)::BIGINT AS crc
  FROM (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL), tables
), groups AS MATERIALIZED (
  SELECT digest, sum(size)::BIGINT AS bytes, row_number() OVER (ORDER BY digest) AS at, sum(sum(size)) OVER (ORDER BY digest)::BIGINT AS until FROM sized GROUP BY digest
), search(low, high, capacity, shard, held, done) AS (
  SELECT greatest(max(bytes), (sum(bytes) + 23) // 24)::BIGINT, sum(bytes)::BIGINT, 0::BIGINT, 0, 0::BIGINT, false FROM groups
  UNION ALL
  SELECT CASE WHEN finished AND NOT fits THEN tried + 1 ELSE low END::BIGINT, CASE WHEN finished AND fits THEN tried ELSE high END::BIGINT,
         CASE WHEN finished THEN 0 ELSE tried END::BIGINT, CASE WHEN finished THEN 0 ELSE shard + 1 END, CASE WHEN finished THEN 0 ELSE reached END::BIGINT,
         finished AND CASE WHEN fits THEN tried ELSE high END <= CASE WHEN fits THEN low ELSE tried + 1 END
  FROM (SELECT *, shard = 23 OR reached = total AS finished, reached = total AS fits
        FROM (SELECT s.*, CASE WHEN capacity = 0 THEN (low + high) // 2 ELSE capacity END AS tried, (SELECT max(until) FROM groups) AS total,
                     (SELECT coalesce(max(until), s.held) FROM groups g WHERE g.until <= s.held + CASE WHEN s.capacity = 0 THEN (s.low + s.high) // 2 ELSE s.capacity END) AS reached
              FROM search s WHERE NOT done))
), best AS (SELECT min(high) AS capacity FROM search WHERE done),
walk(shard, held, reached) AS (
  SELECT 0, 0::BIGINT, (SELECT max(until) FROM groups, best WHERE until <= capacity)
  UNION ALL
  SELECT shard + 1, reached, (SELECT max(until) FROM groups g, best WHERE g.until <= w.reached + capacity) FROM walk w WHERE reached < (SELECT max(until) FROM groups)
)
SELECT s.doc_id, s.size, c.crc AS text_crc32, 'bytes' AS law, w.shard::INTEGER AS shard,
       (row_number() OVER (PARTITION BY w.shard ORDER BY ('0x' || substr(sha256(s.doc_id::VARCHAR), 1, 7))::BIGINT % 256, s.doc_id) - 1)::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM sized s JOIN groups g ON s.digest = g.digest JOIN walk w ON g.until > w.held AND g.until <= w.reached LEFT JOIN crcs c ON s.text = c.text
"""

ORACLES = {
    "op1_url_filter": _URL_SQL,
    "op2_topk_search": _TOPK_SQL,
    "op3_suffix_dedup": _SUFFIX_SQL,
    "op4_jaccard_join": _JACCARD_SQL,
    "op6_embedding_dedup": _FOREST_SQL,
    "op10_sharding": _SHARD_SQL,
}
