"""The registered queries of this package, and SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekcast.llm import (
    bpe,
    decontaminate,
    hard_negatives,
    quality_gam,
    ring,
    simhash,
    spelling,
    suffix_dedup,
    token_counts,
    token_store,
    toxicity,
    url_filter,
    weak_rules,
)
from weekcast.llm.common import new_folder, read

Query = Callable[[SparkSession, str], DataFrame]


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document before and after its personal data are redacted."""
    edits = token_counts.with_redactions(read(spark, sf_dir, "documents"))
    return token_counts.edited_counts(edits, with_text=False)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages).select("page_id", "host", "path", "rule", "verdict")


def op3_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_gam.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.drop("spans")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits().alias("fingerprint"), "component_id")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.without_repeats(read(spark, sf_dir, "documents"), digest=True)


def op7_weak_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_rules.judge(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality"
    )


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.store_and_read(read(spark, sf_dir, "documents"))


def token_store_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every document whose key 20 divides, read from a store of all documents."""
    docs = read(spark, sf_dir, "documents")
    folder = new_folder(spark)
    token_store.write_store(docs, folder)
    found = token_store.lookup(spark, folder, docs.where("doc_id % 20 = 0"))
    return found.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read(spark, sf_dir, "documents"))


def op10_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ring.assign(read(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where 7 divides the key, the label is another one: those are the planted hard cases."""
    rows = read(spark, sf_dir, "embeddings")
    return hard_negatives.mine(rows.withColumn("label", F.expr("IF(vec_id % 7 = 0, (label + 1) % 10, label)")))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read(spark, sf_dir, "documents"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``evidence``: the doc_ids of the nearest labelled documents, the nearest first."""
    found = toxicity.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted", F.col("evidence.doc_id").alias("evidence"))


QUERIES: dict[str, Query] = {
    "op1_token_counts": op1_token_counts,
    "op2_url_filter": op2_url_filter,
    "op3_quality_gam": op3_quality_gam,
    "op4_decontamination": op4_decontamination,
    "op5_simhash": op5_simhash,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_weak_rules": op7_weak_rules,
    "op8_token_store": op8_token_store,
    "token_store_lookup": token_store_lookup,
    "op9_bpe": op9_bpe,
    "op10_ring": op10_ring,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_spelling": op12_spelling,
    "op13_toxicity": op13_toxicity,
}

SQL: dict[str, str] = {
    "op2_url_filter": r"""
WITH cut AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages
), judged AS (
  SELECT *, CASE
    WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM cut
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM judged""",
    "op4_decontamination": r"""
WITH cut AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
  FROM documents
), bench AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
  FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[k : k + least(len(w), 10) - 1], ' ') AS words
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS k FROM bench WHERE len(w) > 0)
), places AS (
  SELECT doc_id, k, n, array_to_string(w[k : k + n - 1], ' ') AS words
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS k
        FROM cut CROSS JOIN (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)
), hits AS (
  SELECT p.doc_id, p.k, p.n, x.item_id FROM places p JOIN windows x ON x.n = p.n AND x.words = p.words
), counted AS (
  SELECT doc_id, COUNT(DISTINCT place) AS n_hit
  FROM (SELECT DISTINCT doc_id, unnest(generate_series(k, k + n - 1)) AS place FROM (SELECT DISTINCT doc_id, k, n FROM hits))
  GROUP BY 1
), named AS (
  SELECT doc_id, COUNT(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY 1
)
SELECT c.doc_id, len(c.w) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items,
  sha256(coalesce(i.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM cut c LEFT JOIN counted h ON h.doc_id = c.doc_id LEFT JOIN named i ON i.doc_id = c.doc_id""",
    "op6_suffix_dedup": """
WITH texts AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), windows AS (
  SELECT doc_id, k, substr(h, CAST(2 * k + 1 AS BIGINT), 100) AS bytes
  FROM (SELECT doc_id, h, unnest(generate_series(0, length(h) // 2 - 50)) AS k FROM texts WHERE length(h) >= 100)
), firsts AS (
  SELECT bytes, MIN(doc_id) AS first_doc FROM windows GROUP BY bytes
), repeated AS (
  SELECT w.doc_id, w.k FROM windows w JOIN firsts f ON f.bytes = w.bytes WHERE w.doc_id > f.first_doc
), begun AS (
  SELECT doc_id, k, CASE WHEN k <= lag(k) OVER o + 50 THEN 0 ELSE 1 END AS new
  FROM repeated WINDOW o AS (PARTITION BY doc_id ORDER BY k)
), spans AS (
  SELECT doc_id, MIN(k) AS a, MAX(k) + 50 AS b
  FROM (SELECT *, SUM(new) OVER (PARTITION BY doc_id ORDER BY k) AS run FROM begun) GROUP BY doc_id, run
), sums AS (
  SELECT doc_id, SUM(b - a) AS n_removed, COUNT(*) AS n_spans, MAX(b) AS last FROM spans GROUP BY doc_id
), pieces AS (
  SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS x, a AS y FROM spans
  UNION ALL
  SELECT t.doc_id, coalesce(s.last, 0), length(t.h) // 2 FROM texts t LEFT JOIN sums s ON s.doc_id = t.doc_id
), kept AS (
  SELECT p.doc_id, string_agg(substr(t.h, CAST(2 * p.x + 1 AS BIGINT), CAST(2 * (p.y - p.x) AS BIGINT)), '' ORDER BY p.x, p.y) AS h
  FROM pieces p JOIN texts t ON t.doc_id = p.doc_id GROUP BY p.doc_id
)
SELECT t.doc_id, length(t.h) // 2 AS n_bytes, CAST(coalesce(s.n_removed, 0) AS BIGINT) AS n_removed,
  coalesce(s.n_spans, 0) AS n_spans, sha256(unhex(k.h)) AS kept_sha256
FROM texts t JOIN kept k ON k.doc_id = t.doc_id LEFT JOIN sums s ON s.doc_id = t.doc_id""",
    "op11_hard_negatives": """
WITH whole AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM whole a JOIN whole b ON b.vec_id <> a.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
), ranked AS (
  SELECT p.*, s.id AS negative_id, s.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank
  FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
    AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 5""",
}
