"""The numbered operators as queries over the test tables, each over its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, embedding_dedup, html_extract, langid, packing, sharding, simhash, substring_dedup, toxicity, url_filter
from .common import broadcast_if_small, checkpoint_dir, is_training, table


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_links(table(spark, sf_dir, "embeddings"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(is_training()))
    got = langid.identify(docs, model)
    return got.select("doc_id", (~is_training()).alias("held_out"), "lang_pred", "score")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs.where(is_training()), labels.where(is_training()))
    got = toxicity.score(docs, model)
    return got.select("doc_id", (~is_training()).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of op 7 the rules alone decide, which SQL can say as well."""
    return url_filter.apply_rules(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight arrival runs of documents, compacted; each document as read from the committed shards.

    ``committed`` says that the file it was read from is named by the manifest and not much larger than a shard may be.
    """
    store = sharding.ShardStore(spark, f"{checkpoint_dir(spark)}/shards-{uuid.uuid4().hex}")
    store.append(table(spark, sf_dir, "documents"), F.pmod(F.xxhash64("doc_id"), F.lit(8)))
    store.settle()
    store.vacuum()
    named = store.manifest().select(F.element_at(F.split("path", "/"), -1).alias("shard"), (F.col("bytes") <= 2 * store.target).alias("committed"))
    rows = store.snapshot().select("doc_id", "shard", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))
    return rows.join(broadcast_if_small(named), "shard", "left").select("doc_id", "n_bytes", "text_sha256", F.coalesce("committed", F.lit(False)).alias("committed"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_substring_dedup, op2_html_extract, op3_embedding_dedup, op4_language_id, op5_decontaminate, op6_toxicity, op7_url_filter, url_rules, op8_packing, op9_simhash, op10_sharding)
}

_OP1 = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x09-\x0D ]+'), lambda x: x <> '') AS w FROM documents
), p AS (
  SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, w FROM d
), win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS s FROM p WHERE i + 49 <= len(w)
), first AS (
  SELECT s, min(doc_id) AS owner FROM win GROUP BY s
), hit AS (
  SELECT win.doc_id, win.i FROM win JOIN first ON win.s = first.s WHERE first.owner < win.doc_id
), gone AS (
  SELECT DISTINCT doc_id, i + k AS i FROM hit, (SELECT unnest(range(0, 50)) AS k)
), left_over AS (
  SELECT p.doc_id, string_agg(p.w[p.i], ' ' ORDER BY p.i) AS kept, count(*) AS n
  FROM p LEFT JOIN gone ON p.doc_id = gone.doc_id AND p.i = gone.i WHERE gone.i IS NULL GROUP BY p.doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN left_over ON d.doc_id = left_over.doc_id
"""

_OP3 = """
WITH RECURSIVE e AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93
), reach(a, b) AS (
  SELECT a, b FROM pairs UNION SELECT reach.a, pairs.b FROM reach JOIN pairs ON reach.b = pairs.a
), c AS (
  SELECT x.vec_id, CAST((SELECT count(*) FROM pairs WHERE pairs.a = x.vec_id) AS BIGINT) AS n_links,
    least(x.vec_id, coalesce((SELECT min(b) FROM reach WHERE reach.a = x.vec_id), x.vec_id)) AS component_id
  FROM embeddings x
)
SELECT vec_id, n_links, component_id, vec_id = component_id AS kept FROM c
"""

_OP5 = r"""
WITH d AS (
  SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) - 1 AS i FROM (
    SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{M}\p{N}\x09-\x0D\x1C-\x1F\x20\x85\p{Z}]+', '', 'g'), '[\x09-\x0D\x1C-\x1F\x20\x85\p{Z}]+'), lambda x: x <> '') AS w FROM documents)
), items AS (
  SELECT item_id, list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{M}\p{N}\x09-\x0D\x1C-\x1F\x20\x85\p{Z}]+', '', 'g'), '[\x09-\x0D\x1C-\x1F\x20\x85\p{Z}]+'), lambda x: x <> '') AS w FROM benchmark
), b AS (
  SELECT item_id, len(w) AS n, unnest(w) AS w, generate_subscripts(w, 1) - 1 AS k FROM items
), same AS (
  SELECT doc_id, item_id, n, i - k AS start, k FROM d JOIN b ON d.w = b.w
), runs AS (
  SELECT *, count(*) OVER (PARTITION BY doc_id, item_id, start ORDER BY k RANGE BETWEEN CURRENT ROW AND 15 FOLLOWING) AS here,
    count(*) OVER (PARTITION BY doc_id, item_id, start) AS matched
  FROM same
), found AS (
  SELECT doc_id, item_id, n, start, matched FROM runs GROUP BY ALL HAVING max(here) >= least(n, 16) - CASE WHEN n >= 16 THEN 2 WHEN n >= 13 THEN 1 ELSE 0 END
)
SELECT doc_id, item_id, CAST(-max_by(-start, (matched, -start)) AS INTEGER) AS start, CAST(max(matched) AS INTEGER) AS matched, CAST(n AS INTEGER) AS n_tokens
FROM found GROUP BY doc_id, item_id, n
"""

_RULES = r"""
WITH p AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p
), r(rule, name, start, verdict) AS (
  VALUES ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'), ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')
), best AS (
  SELECT page_id, max_by(r.rule, length(r.rule)) AS rule, max_by(r.verdict, length(r.rule)) AS verdict
  FROM h JOIN r ON (h.host = r.name OR ends_with(h.host, '.' || r.name)) AND starts_with(h.path, r.start) GROUP BY page_id
)
SELECT h.page_id, host, path, rule, verdict FROM h LEFT JOIN best ON h.page_id = best.page_id
"""

_OP10 = "SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n_bytes, sha256(text) AS text_sha256, TRUE AS committed FROM documents"

#: The others learn a model, or use a hash or tokenizer that SQL lacks: tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {"op1_substring_dedup": _OP1, "op3_embedding_dedup": _OP3, "op5_decontaminate": _OP5, "url_rules": _RULES, "op10_sharding": _OP10}
