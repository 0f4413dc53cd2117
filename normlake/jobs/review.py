"""Registered review, cache and mirror queries: documents are rules, labels decisions on them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import shared_path
from ..operators import bundles
from ..operators import review as v
from ..sources import cache


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rules(spark: SparkSession, sf_dir: str, source: str = "source") -> DataFrame:
    fields = {"text": F.col("text"), "lang": F.col("lang"), "source": F.expr(source)}
    return _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("rule_id"), F.col("text").alias("statement"), v.fingerprint(fields).alias("hash"))


def _decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality 1 approves, toxic 1 modifies, quality 0 stays pending; hashes are those of the rules, stale for ids that 7 divides."""
    decision = F.when(F.col("toxic") == 1, "modified").when(F.col("quality") == 1, "approved").otherwise("pending_review")
    labels = _t(spark, sf_dir, "labels").select(F.col("doc_id").alias("rule_id"), decision.alias("decision"), F.when(F.col("toxic") == 1, "edited").alias("edited"), F.lit("").alias("notes"))
    hashes = _rules(spark, sf_dir).select("rule_id", F.when(F.col("rule_id") % 7 == 0, "stale").otherwise(F.col("hash")).alias("review_hash"))
    return labels.join(hashes, "rule_id", "left")


def fingerprint_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rules(spark, sf_dir).select("rule_id", "hash")


def decision_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    decision = F.when(F.col("toxic") == 1, "modified").when(F.col("quality") == 1, "approved").otherwise("rejected")
    labels = _t(spark, sf_dir, "labels").select(F.col("doc_id").alias("rule_id"), F.when(F.col("quality").isNotNull(), decision).alias("decision"))
    return v.decision_counts(_t(spark, sf_dir, "documents").select(F.col("doc_id").alias("rule_id")), labels)


def rule_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = v.rule_view(_rules(spark, sf_dir), _decisions(spark, sf_dir))
    return shown.select("rule_id", "decision", "edited", "notes", "current", "decision_hash")


def locked_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compare and set: every third decision is updated with the hash that was shown, every ninth with an old one, some ids are unknown."""
    current = _decisions(spark, sf_dir)
    updates = current.where("rule_id % 3 = 0").select(F.when(F.col("rule_id") % 5 == 0, -F.col("rule_id") - 1).otherwise(F.col("rule_id")).alias("rule_id"), F.when(F.col("rule_id") % 9 == 0, "old").otherwise(v.decision_fingerprint()).alias("expected"), F.lit("rejected").alias("decision"))
    return v.update_decisions(current, updates)


def id_set_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that labels lack or hold beyond documents."""
    docs, labels = _t(spark, sf_dir, "documents").where("doc_id % 3 > 0").select("doc_id"), _t(spark, sf_dir, "labels").where("doc_id % 3 < 2").select("doc_id")
    return v.same_ids(docs, labels, "doc_id")


def status_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("rule_id"), F.col("source").alias("document"))
    active = v.apply(_rules(spark, sf_dir), _decisions(spark, sf_dir))
    return bundles.status(rules, _decisions(spark, sf_dir), active)


def reconcile_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = _rules(spark, sf_dir, "CASE WHEN doc_id % 5 = 0 THEN 'new' ELSE source END").where("rule_id % 11 <> 0")
    return v.reconcile(_rules(spark, sf_dir), _decisions(spark, sf_dir), changed)


def apply_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.apply(_rules(spark, sf_dir), _decisions(spark, sf_dir)).groupBy("status").agg(F.count("*").alias("n"), F.sum(F.length("statement")).alias("chars"))


def bundle_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.bundle_id(_rules(spark, sf_dir).select("rule_id", "hash"))


def cache_hit_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents")
    keyed = docs.select("lang", F.sha2(F.concat(F.lit("model:"), "text"), 256).alias("key"))
    cache = docs.join(_t(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi").select(F.sha2(F.concat(F.lit("model:"), "text"), 256).alias("key"))
    return v.cache_misses(keyed, cache).groupBy("lang").agg(F.count_if("cached").alias("cached"), F.count_if(~F.col("cached")).alias("generated"))


def _measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A provider that needs no network: the number of words and the first one."""
    for batch in batches:
        words = batch["text"].fillna("").str.split(" ")
        yield pd.DataFrame({"key": batch["key"], "n": words.str.len(), "first": words.str[0]})


def cached_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a provider says of each text, asked only for texts that the cache (those of labelled documents) lacks."""
    docs = _t(spark, sf_dir, "documents")
    keyed = docs.select(F.sha2(F.concat(F.lit("model:"), "text"), 256).alias("key"), "text")
    words = F.split("text", " ")
    cache = keyed.join(docs.join(_t(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi").select(F.sha2(F.concat(F.lit("model:"), "text"), 256).alias("key")).distinct(), "key", "left_semi").dropDuplicates(["key"])
    return v.enriched(keyed, cache.select("key", F.size(words).cast("long").alias("n"), F.element_at(words, 1).alias("first")), _measure, "n long, first string")


def _embed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A stand-in for a model: four counts of a text as its vector."""
    for b in batches:
        yield pd.DataFrame({"key": b["key"], "v": [[float(len(t)), float(t.count(" ")), float(t.count("e")), 1.0] for t in b["text"]]})


def written_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of all texts from a cache that was filled with those of French ones before: the provider is asked for the others alone, once for each text, and never again."""
    path, docs = shared_path(spark, "cache"), _t(spark, sf_dir, "documents")
    keyed = docs.select(cache.key_of("embedding-v1", "counts", F.col("text"), 4).alias("key"), "text", "lang")
    size = F.size("v") == 4
    cache.filled(keyed.where("lang = 'fr'"), path, _embed, "v array<double>", size, 2)
    found = cache.filled(keyed, path, _embed, "v array<double>", size, 2).select("key", "v", "cached")
    again = cache.filled(keyed, path, _embed, "v array<double>", size, 2).select("key", F.col("cached").alias("cached_again"))
    return found.join(again, "key").select("key", F.element_at("v", 1).alias("n"), F.element_at("v", 2).alias("spaces"), F.element_at("v", 3).alias("es"), "cached", "cached_again")


def mirror_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    current = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    incoming = _t(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 20).alias("k"), F.col("s_name").alias("name"), F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("balance"))
    return v.mirror(current, incoming, "k")


def uniform_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.uniform_dimension(_t(spark, sf_dir, "embeddings"), "embedding")


def multi_field_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = v.matching(_t(spark, sf_dir, "part").where("p_size > 20"), "PROMO", ["p_name", "p_brand", "p_type"], p_brand=["brand#11", "Brand#13", "Brand#31"])
    return found.select("p_partkey", "p_brand", "p_type", "p_size")


QUERIES = {f.__name__: f for f in (fingerprint_rows, decision_counts, reconcile_decisions, apply_decisions, bundle_fingerprint, cache_hit_miss, mirror_upsert, uniform_dimension, multi_field_filter, rule_view, locked_updates, id_set_problems, status_rollup, cached_enrichment, written_back)}
_HASH = "sha256(json_object('lang', lang, 'source', {0}, 'text', text)::varchar)"
_SHOWN = "sha256(json_object('decision', decision, 'edited', edited, 'notes', '', 'review_hash', review_hash, 'rule_id', rule_id)::varchar)"
_D = f"""d AS (SELECT doc_id AS rule_id, CASE WHEN toxic = 1 THEN 'modified' WHEN quality = 1 THEN 'approved' ELSE 'pending_review' END AS decision, CASE WHEN toxic = 1 THEN 'edited' END AS edited,
  CASE WHEN doc_id % 7 = 0 THEN 'stale' ELSE {_HASH.format('source')} END AS review_hash FROM labels LEFT JOIN documents USING (doc_id))"""
ORACLES = {
    "written_back": """SELECT sha256('{"dimensions":4,"model":"counts","purpose":"embedding-v1","text":' || to_json(text)::varchar || '}') AS key, any_value(length(text)::double) AS n, any_value((length(text) - length(replace(text, ' ', '')))::double) AS spaces,
      any_value((length(text) - length(replace(text, 'e', '')))::double) AS es, bool_or(lang = 'fr') AS cached, true AS cached_again FROM documents GROUP BY 1""",
    "cached_enrichment": "SELECT sha256('model:' || text) AS key, any_value(len(string_split(text, ' '))) AS n, any_value(string_split(text, ' ')[1]) AS first, bool_or(l.doc_id IS NOT NULL) AS cached FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1",
    "fingerprint_rows": f"SELECT doc_id AS rule_id, {_HASH.format('source')} AS hash FROM documents",
    "bundle_fingerprint": f"""WITH r AS (SELECT doc_id AS rule_id, {_HASH.format('source')} AS hash FROM documents), b AS (SELECT substr(hash, 1, 2) AS b, sha256(string_agg(rule_id || ':' || hash, chr(10) ORDER BY rule_id)) AS h, count(*) AS n FROM r GROUP BY 1)
      SELECT sha256(string_agg(h, chr(10) ORDER BY b)) AS bundle_id, sum(n)::bigint AS rule_count FROM b""",
    "decision_counts": "SELECT decision, count(*) AS n, count(*) FILTER (decision IN ('approved', 'modified')) AS n_active FROM (SELECT CASE WHEN quality IS NULL THEN 'pending_review' WHEN toxic = 1 THEN 'modified' WHEN quality = 1 THEN 'approved' ELSE 'rejected' END AS decision FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY decision",
    "reconcile_decisions": f"""WITH {_D}, o AS (SELECT doc_id AS rule_id, {_HASH.format('source')} AS old_hash FROM documents), n AS (SELECT doc_id AS rule_id, {_HASH.format("(CASE WHEN doc_id % 5 = 0 THEN 'new' ELSE source END)")} AS new_hash FROM documents WHERE doc_id % 11 <> 0)
      SELECT rule_id, decision, CASE WHEN review_hash = old_hash AND old_hash = new_hash THEN 'preserved' ELSE 'dropped' END AS outcome FROM d LEFT JOIN o USING (rule_id) LEFT JOIN n USING (rule_id) WHERE decision <> 'pending_review' OR coalesce(edited, '') <> ''""",
    "apply_decisions": f"""WITH {_D}, r AS (SELECT doc_id AS rule_id, text AS statement, {_HASH.format('source')} AS hash FROM documents)
      SELECT status, count(*) AS n, sum(length(statement))::bigint AS chars FROM (SELECT CASE WHEN hash IS NULL THEN 'unknown_rule' WHEN decision IS NULL THEN 'pending_review' WHEN review_hash <> hash THEN 'stale_hash' WHEN decision = 'modified' THEN 'approved' ELSE decision END AS status,
      CASE WHEN decision = 'modified' AND review_hash = hash THEN edited ELSE statement END AS statement FROM r FULL JOIN d USING (rule_id)) GROUP BY status""",
    "cache_hit_miss": "SELECT lang, count(*) FILTER (hit) AS cached, count(*) FILTER (NOT hit) AS generated FROM (SELECT lang, sha256('model:' || text) IN (SELECT sha256('model:' || text) FROM documents JOIN labels USING (doc_id)) AS hit FROM documents) GROUP BY lang",
    "mirror_upsert": """SELECT k, coalesce(b.name, a.name) AS name, coalesce(b.balance, a.balance) AS balance, CASE WHEN b.name IS NULL THEN 'kept' WHEN a.name IS NULL THEN 'inserted' ELSE 'updated' END AS change
      FROM (SELECT c_custkey AS k, c_name AS name, c_acctbal AS balance FROM customer) a FULL JOIN (SELECT s_suppkey * 20 AS k, s_name AS name, CASE WHEN s_acctbal > 0 THEN s_acctbal END AS balance FROM supplier) b USING (k)""",
    "uniform_dimension": "SELECT count(*) AS n, min(len(embedding)) AS least, max(len(embedding)) AS most, min(len(embedding)) = max(len(embedding)) AS uniform FROM embeddings",
    "multi_field_filter": "SELECT p_partkey, p_brand, p_type, p_size FROM part WHERE contains(lower(concat_ws(chr(10), p_name, p_brand, p_type)), 'promo') AND p_size > 20 AND p_brand IN ('Brand#11', 'Brand#13', 'Brand#31')",
    "rule_view": f"WITH {_D}, r AS (SELECT doc_id AS rule_id, {_HASH.format('source')} AS hash FROM documents) SELECT rule_id, coalesce(decision, 'pending_review') AS decision, coalesce(edited, '') AS edited, '' AS notes, coalesce(review_hash = hash, false) AS current, CASE WHEN decision IS NOT NULL THEN {_SHOWN} END AS decision_hash FROM r LEFT JOIN d USING (rule_id)",
    "locked_updates": f"""WITH {_D}, h AS (SELECT rule_id, decision, {_SHOWN} AS hash FROM d), u AS (SELECT CASE WHEN rule_id % 5 = 0 THEN -rule_id - 1 ELSE rule_id END AS rule_id, CASE WHEN rule_id % 9 = 0 THEN 'old' ELSE hash END AS expected FROM h WHERE rule_id % 3 = 0),
      o AS (SELECT rule_id, decision, CASE WHEN expected IS NULL THEN 'kept' WHEN hash IS NULL THEN 'unknown' WHEN expected = hash THEN 'updated' ELSE 'conflict' END AS outcome FROM h FULL JOIN u USING (rule_id))
      SELECT rule_id, CASE WHEN outcome = 'updated' THEN 'rejected' ELSE decision END AS decision, outcome FROM o""",
    "id_set_problems": "SELECT doc_id, CASE WHEN l IS NULL THEN 'missing' ELSE 'unexpected' END AS problem FROM (SELECT doc_id, doc_id AS d FROM documents WHERE doc_id % 3 > 0) FULL JOIN (SELECT doc_id, doc_id AS l FROM labels WHERE doc_id % 3 < 2) USING (doc_id) WHERE d IS NULL OR l IS NULL",
    "status_rollup": f"""WITH {_D}, r AS (SELECT doc_id AS rule_id, source, {_HASH.format('source')} AS hash FROM documents), j AS (SELECT rule_id, source, coalesce(decision, 'pending_review') AS decision, decision IN ('approved', 'modified') AND review_hash = hash AS live FROM r LEFT JOIN d USING (rule_id))
      SELECT count(*)::bigint AS candidates, count(*) FILTER (decision = 'pending_review')::bigint AS pending, count(*) FILTER (decision IN ('approved', 'modified'))::bigint AS approved, count(DISTINCT source) AS documents, count(*) FILTER (live) AS active FROM j""",
}
