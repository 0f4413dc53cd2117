"""Registered runtime query: documents as an active bundle with checks, index and vectors, pages as edits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import shared_path
from ..operators import bundles as b
from ..operators import runtime
from .retrieval import _post, four_places

LIMIT, SCOPES = 10, ["Company", "department"]


def rule_bundle(spark: SparkSession, sf_dir: str) -> b.Bundle:
    """Documents as approved rules: a tenth have two checks, a tenth one, the others none that applies by itself; vectors are those of the same number."""
    k, line = F.col("doc_id"), F.element_at(F.split("text", "\n"), 1)
    severity = F.when(k % 3 == 0, "blocker").when(k % 3 == 1, "major").otherwise("advisory")
    scope = F.when(F.col("lang") == "en", "company").when(F.col("lang") == "fr", "department").otherwise("project")
    check = lambda **v: F.struct(*[(F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) if x else F.lit(None).cast("array<string>")).alias(n) for n, x in v.items()])
    two = F.array(check(type="regex_forbid", pattern=["x"], paths=None, include_paths=["**/en/*"], when_terms=None), check(type="ai_review", pattern=None, paths=None, include_paths=None, when_terms=["<TABLE"]))
    one = F.array(check(type="path_forbid", pattern=None, paths=["*.tmp"], include_paths=["**/fr/*"], when_terms=None))
    meta = F.struct(F.when(k % 10 == 0, two).when(k % 10 == 1, one).alias("checks"), F.when(k % 10 == 0, F.array(F.lit("<table"), F.lit("/es/"))).otherwise(F.array().cast("array<string>")).alias("direct_triggers"), (k % 7 == 0).alias("enforcement_disabled"))
    record = F.struct(F.concat_ws("-", "source", "doc_id").alias("id"), F.substring(line, 1, 40).alias("title"), F.col("text").alias("statement"), scope.alias("scope"), F.when(k % 2 == 0, "api").otherwise("coding").alias("category"), severity.alias("severity"), F.struct(F.col("source").alias("document"), F.col("lang").alias("section")).alias("source"), F.array(F.element_at(F.split(line, "[ .,]"), 1), F.col("lang")).alias("trigger_terms"), meta.alias("metadata"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("doc_id", F.concat_ws("-", "source", "doc_id").alias("rule_id"), F.col("text").alias("statement"), F.to_json(record).alias("record")).withColumn("hash", F.sha2("record", 256))
    decisions = rows.select("rule_id", F.lit("approved").alias("decision"), F.col("hash").alias("review_hash"), F.lit("").alias("edited"), F.lit("").alias("notes"))
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("v")).join(docs.select("doc_id", "source"), "doc_id")
    live = shared_path(spark, "live")
    b.activate(rows.drop("doc_id"), decisions, live, "v1", vectors=vectors.select(F.concat_ws("-", "source", "doc_id").alias("rule_id"), "v"))
    return b.read_bundle(spark, live)


def edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark texts as tasks on the page of the same number, every second one with a vector."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("query_id"), F.regexp_replace("url", r"^https?://[^/]+/", "").alias("path"), F.col("html").alias("code"))
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id % 20 = 0").select((F.col("vec_id") / 10).cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("q"))
    return items.join(pages, "query_id").join(vectors, "query_id", "left")


def runtime_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the bundle says about each edit: direct rules, then ranked ones by text and vector, of two scopes."""
    found = runtime.runtime_rules(rule_bundle(spark, sf_dir), edits(spark, sf_dir), LIMIT, SCOPES, probes=64)
    return found.select("query_id", "rule_id", "direct", four_places("score"), F.array_join("checkers", ",").alias("checkers"), "place", F.array_join("hits", ",").alias("hits"), "severity", "category")


QUERIES = {"runtime_search": runtime_search}
_R = """rl AS (SELECT *, source || '-' || doc_id AS id, string_split(text, chr(10))[1] AS line, CASE doc_id % 3 WHEN 0 THEN 'blocker' WHEN 1 THEN 'major' ELSE 'advisory' END AS severity, CASE lang WHEN 'en' THEN 'company' WHEN 'fr' THEN 'department' ELSE 'project' END AS scope FROM documents),
  rr AS (SELECT doc_id, id, text, severity, scope, CASE WHEN doc_id % 2 = 0 THEN 'api' ELSE 'coding' END AS category, source || ' ' || lang AS spot, substr(line, 1, 40) AS title, [string_split_regex(line, '[ .,]')[1], lang] AS triggers FROM rl)"""
_F = " UNION ALL ".join(f"SELECT doc_id, token, tf * {n} AS tf FROM ({_post('rr', 'doc_id', c)})" for c, n in (("id", 5), ("title", 4), ("text", 3), ("spot", 1), ("array_to_string(triggers, ' ')", 5), ("category", 1), ("scope", 1)))
_Q = " UNION ALL ".join(f"SELECT DISTINCT doc_id AS query_id, token, {w} AS w FROM ({_post('qt', 'query_id', c)})" for c, w in (("query", "3e0"), ("path", "2e0"), ("code", "1e0")))
_EN, _FR = ("(regexp_matches(lower(path), '(?s)^(.*/)?{0}/.*$') OR regexp_matches(string_split(lower(path), '/')[-1], '(?s)^(.*/)?{0}/.*$'))".format(x) for x in ("en", "fr"))
ORACLES = {
    "runtime_search": f"""WITH {_R}, qt AS (SELECT item_id AS query_id, text AS query, regexp_replace(url, '^https?://[^/]+/', '') AS path, html AS code FROM benchmark JOIN pages ON page_id = item_id),
      p AS (SELECT doc_id, token, sum(tf) AS tf FROM ({_F}) GROUP BY doc_id, token), dl AS (SELECT doc_id, sum(tf) AS dl FROM p GROUP BY doc_id), dfs AS (SELECT token, count(*) AS df FROM p GROUP BY token),
      tot AS (SELECT count(*) AS n, avg(greatest(coalesce(dl, 0), 1)::double) AS avgdl FROM documents LEFT JOIN dl USING (doc_id)), q AS (SELECT query_id, token, sum(w) AS w FROM ({_Q}) GROUP BY query_id, token),
      raw AS (SELECT query_id, doc_id, sum(w * ln(1e0 + (n - df + 0.5e0) / (df + 0.5e0)) * tf * 2.5e0 / (tf + 1.5e0 * (0.25e0 + 0.75e0 * dl / greatest(avgdl, 1e0)))) AS score FROM p JOIN q USING (token) JOIN dfs USING (token) JOIN dl USING (doc_id), tot GROUP BY query_id, doc_id),
      b AS (SELECT query_id, doc_id, score, contains(lower(query), lower(id)) AS named, list_filter(triggers, lambda t: t <> '' AND (contains(lower(query), lower(t)) OR contains(lower(path), lower(t)) OR contains(lower(code), lower(t)))) AS hits FROM raw JOIN rr USING (doc_id) JOIN qt USING (query_id)),
      s AS (SELECT query_id, doc_id, round_even(score + CASE WHEN named THEN 12e0 ELSE 0e0 END + 2.5e0 * len(hits), 6) AS score, hits FROM b),
      v AS (SELECT query_id, doc_id, sim FROM (SELECT x.vec_id // 10 AS query_id, y.vec_id AS doc_id, list_cosine_similarity(x.embedding::double[], y.embedding::double[]) AS sim FROM embeddings x, embeddings y WHERE x.vec_id % 20 = 0) JOIN qt USING (query_id) JOIN documents USING (doc_id) WHERE sim >= 0.28e0),
      h AS (SELECT query_id, doc_id, coalesce(score, 0) + 0.4e0 * 8e0 * greatest(0e0, round_even(coalesce(sim, 0e0), 6)) AS score, hits FROM s FULL JOIN v USING (query_id, doc_id)),
      c AS (SELECT * FROM h JOIN rr USING (doc_id) WHERE scope IN ('company', 'department')),
      k AS (SELECT query_id, doc_id, score, c.hits, max(score) OVER w AS best, row_number() OVER (w ORDER BY score DESC, list_position(['blocker', 'major', 'advisory'], severity), id) AS rank FROM c WINDOW w AS (PARTITION BY query_id)),
      t AS (SELECT * FROM k WHERE rank <= {LIMIT} AND score >= greatest(0, best * 0.22e0)),
      f AS (SELECT query_id, doc_id, id, severity, {_EN} AND doc_id % 10 = 0 AS fi, contains(lower(query || chr(10) || code), '<table') AND doc_id % 10 = 0 AS ta, {_FR} AND doc_id % 10 = 1 AS pa, CASE WHEN doc_id % 10 = 0 THEN len(list_filter(['<table', '/es/'], lambda x: contains(lower(path || chr(10) || query || chr(10) || code), x))) ELSE 0 END AS terms FROM qt, rr),
      d AS (SELECT query_id, doc_id, array_to_string(list_filter([CASE WHEN ta THEN 'ai_review' END, CASE WHEN pa THEN 'path_forbid' END, CASE WHEN fi THEN 'regex_forbid' END], lambda x: x IS NOT NULL), ',') AS checkers,
        row_number() OVER (PARTITION BY query_id ORDER BY 1 + 4 * terms + CASE WHEN fi OR pa THEN 3 ELSE 0 END + CASE WHEN ta THEN 3 ELSE 0 END + CASE WHEN severity = 'blocker' THEN 2 ELSE 0 END DESC, id) AS pos FROM f WHERE fi OR ta OR pa),
      e AS (SELECT d.* FROM d JOIN rr USING (doc_id) WHERE scope IN ('company', 'department')),
      m AS (SELECT query_id, doc_id, e.pos IS NOT NULL AS direct, score, coalesce(checkers, '') AS checkers, hits, row_number() OVER (PARTITION BY query_id ORDER BY (e.pos IS NOT NULL) DESC, e.pos NULLS LAST, t.rank) AS place FROM e FULL JOIN t USING (query_id, doc_id))
      SELECT query_id, id AS rule_id, direct, round(score, 4) AS score, checkers, place, coalesce(array_to_string(hits, ','), '') AS hits, severity, category FROM m JOIN rr USING (doc_id) WHERE direct OR place <= {LIMIT}""",
}
