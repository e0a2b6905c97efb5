"""The queries of this subpackage with their production parameters, and DuckDB SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, divergence, mixing, negatives, neighbours, packing, pieces, quality, sharding, simhash, tokenfile, topk, urlfilter
from .common import table

SHARDS = 40
QUERY_EVERY, TOP = 50, 5
ANCHOR_EVERY, POSITIVES, NEGATIVES = 100, 5, 5
#: Every so many a vec_id has the next of so many labels.
OTHER_LABEL_EVERY, LABELS = 7, 10
#: Documents of a language that hold a term at least, and terms that a group reports at most.
TERM_DOCS, TOP_TERMS = 3, 200
#: A document of at least this score is predicted to be good.
KEPT_SCORE = 0.3
#: host, path, verdict
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
#: Target shares of sources; the others share REST equally.
MIX_WEIGHTS, MIX_REST, MIX_SIZE, MIX_SEED = {"src0": 0.2, "src1": 0.1, "src2": 0.1}, 0.6, 1.0, 9
PACK_SIZE, PACK_END = 2048, 0


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), KEPT_SCORE)


def sampled_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    put = sharding.shard(table(spark, sf_dir, "documents"), SHARDS)
    return put.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urlfilter.judge(table(spark, sf_dir, "pages"), rules)


def embedding_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.near_duplicates(table(spark, sf_dir, "embeddings"))


def simhash_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex64("fp").alias("fingerprint"), "component_id")


def top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % QUERY_EVERY == 0, TOP)


def token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.token_files(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(table(spark, sf_dir, "conversations"))


def source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), MIX_WEIGHTS, MIX_REST, MIX_SIZE, MIX_SEED)


def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), end_id=PACK_END, size=PACK_SIZE)


def source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"), TERM_DOCS, TOP_TERMS)


def piece_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(pieces.encode(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model")))


def hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    other = F.when(F.col("vec_id") % OTHER_LABEL_EVERY == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    return negatives.mine(vectors.withColumn("label", other), F.col("vec_id") % ANCHOR_EVERY == 0, POSITIVES, NEGATIVES)


QUERIES = {
    "op1_quality_classifier": quality_classifier,
    "op2_sampled_shards": sampled_shards,
    "op3_url_rules": url_rules,
    "op4_embedding_dups": embedding_dups,
    "op5_simhash_dups": simhash_dups,
    "op6_top_products": top_products,
    "op7_token_files": token_files,
    "op8_chat_snapshots": chat_snapshots,
    "op9_source_mix": source_mix,
    "op10_best_fit_packing": best_fit_packing,
    "op11_source_divergence": source_divergence,
    "op12_piece_ids": piece_ids,
    "op13_hard_negatives": hard_negatives,
}

_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
_WEIGHTS = ", ".join(f"('{s}', {w})" for s, w in MIX_WEIGHTS.items())

ORACLES = {
    "op3_url_rules": rf"""
WITH rules(r_host, r_path, verdict) AS (VALUES {_RULES}),
parts AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages)
SELECT page_id, any_value(host) AS host, any_value(path) AS path,
  arg_max(r_host || r_path, length(r_host || r_path)) AS rule,
  coalesce(arg_max(verdict, length(r_host || r_path)), 'allow') AS verdict
FROM parts LEFT JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)
GROUP BY page_id""",
    "op4_embedding_dups": """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
usable AS (
  SELECT vec_id, e FROM v
  WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a, usable b
  WHERE a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach(id, r) AS (
  SELECT vec_id, vec_id FROM v
  UNION
  SELECT reach.id, links.b FROM reach JOIN links ON reach.r = links.a),
least AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT id AS vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, id = component_id AS kept
FROM least LEFT JOIN degree ON id = a""",
    "op6_top_products": f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % {QUERY_EVERY} = 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM placed WHERE rank <= {TOP}""",
    "op8_chat_snapshots": f"""
WITH t AS (
  SELECT conv_id, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
whole AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY pos) AS turns FROM t GROUP BY conv_id),
single AS (SELECT turns, min(conv_id) AS conv_id FROM whole GROUP BY turns),
shorter AS (SELECT DISTINCT turns[1:k] AS turns FROM (SELECT turns, unnest(range(1, len(turns))) AS k FROM single)),
kept AS (SELECT conv_id, len(turns) AS n_turns FROM single ANTI JOIN shorter USING (turns))
SELECT conv_id, ((pos - 1) // {chat.PART_TURNS})::INTEGER AS part, n_turns::BIGINT AS n_turns,
  string_agg('<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10), '' ORDER BY pos) AS text
FROM t JOIN kept USING (conv_id) GROUP BY ALL""",
    "op9_source_mix": f"""
WITH RECURSIVE given(source, w) AS (VALUES {_WEIGHTS}),
counts AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
weighed AS (SELECT counts.source, n, w FROM counts LEFT JOIN given ON counts.source = given.source),
total AS (SELECT sum(n) AS n_all, count(*) FILTER (w IS NULL) AS free, coalesce(sum(w), 0) AS g FROM weighed),
rates AS (
  SELECT source, (coalesce(w, {MIX_REST}::DOUBLE / free) / (g + CASE WHEN free > 0 THEN {MIX_REST} ELSE 0 END)::DOUBLE) * {MIX_SIZE}::DOUBLE * n_all / n AS mean
  FROM weighed, total),
drawn AS (SELECT source, greatest(1, ceil(mean / 16.0))::INTEGER AS draws, mean / greatest(1, ceil(mean / 16.0)) AS m FROM rates),
cdf AS (
  SELECT source, draws, m, 0 AS k, exp(-m) AS p, exp(-m) AS c FROM drawn
  UNION ALL
  SELECT source, draws, m, k + 1, p * m / (k + 1), c + p * m / (k + 1) FROM cdf WHERE k < 80),
lists AS (SELECT source, any_value(draws) AS draws, list(c ORDER BY k) AS cs FROM cdf GROUP BY source),
tries AS (
  SELECT d.*, md5(coalesce(text, '')) AS hashed, cs, unnest(range(1, draws + 1)) AS j FROM documents d JOIN lists ON d.source IS NOT DISTINCT FROM lists.source),
counted AS (
  SELECT * EXCLUDE (cs), len(list_filter(cs, lambda c: c <= ('0x' || substr(md5('{MIX_SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || hashed || ':' || j), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)) AS n
  FROM tries),
copies AS (SELECT doc_id, text, lang, source, n_chars, hashed, (j - 1) * 80 + unnest(range(1, n + 1)) AS copy FROM counted WHERE n > 0)
SELECT * EXCLUDE (hashed), md5('order {MIX_SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || hashed || ':' || copy) AS shuffle_key FROM copies""",
    "op11_source_divergence": rf"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents),
tokens AS (SELECT d, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS n FROM tokens GROUP BY lang, term HAVING count(DISTINCT d) >= {TERM_DOCS}),
groups AS (SELECT DISTINCT lang, source FROM docs),
langs AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, count(*) AS n FROM tokens SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
totals AS (SELECT lang, source, sum(n) AS total FROM counts GROUP BY lang, source),
cells AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    (1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (coalesce(t.total, 0) + v)::HUGEINT) AS p,
    (1 + (1000000000::HUGEINT * (k.n + 1)) // (langs.total + v)::HUGEINT) AS lang_p
  FROM groups g JOIN kept k ON g.lang = k.lang JOIN langs ON g.lang = langs.lang
    LEFT JOIN counts c ON g.lang = c.lang AND g.source = c.source AND k.term = c.term
    LEFT JOIN totals t ON g.lang = t.lang AND g.source = t.source),
summed AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM cells a JOIN cells b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN summed s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (
  SELECT lang, source, 'term' AS part, term AS item, ((p - lang_p) * (p - lang_p) // lang_p)::BIGINT AS value
  FROM cells WHERE n > 0 AND p > lang_p),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT * FROM ranked WHERE part = 'pair' OR rank <= {TOP_TERMS}""",
    "op13_hard_negatives": f"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % {OTHER_LABEL_EVERY} = 0 THEN (label + 1) % {LABELS} ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.e, c.e)::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % {ANCHOR_EVERY} = 0),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES})
SELECT p.anchor_id, positive_id, positive_score, n.vec_id AS negative_id, n.score AS negative_score,
  row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY n.score DESC, n.vec_id)::INTEGER AS rank
FROM positives p JOIN scored n ON p.anchor_id = n.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= {NEGATIVES}""",
}
