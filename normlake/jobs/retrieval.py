"""Registered retrieval queries over documents, pages, benchmark and embeddings, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import shared_path, stored
from ..functions.sizes import broadcast_if_small
from ..functions.text import TOKEN, normalised, postings
from ..operators import bundles, ranking
from ..operators import retrieval as r
from ..operators.vectors import nearest

STOP = ["the", "of", "and", "to", "in", "is", "http", "com", "example", "www", "org", "net", "html"]


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.query_terms(_queries(spark, sf_dir), {"query": "query"})


def _lexical(spark: SparkSession, sf_dir: str, limit: int) -> DataFrame:
    """Each query's ``limit`` best documents."""
    return r.top_k(ranking.search(_t(spark, sf_dir, "documents"), _terms(spark, sf_dir), limit).drop("direct"), limit)


def four_places(score: str) -> Column:
    """``score`` rounded as DuckDB does it, by the product: 70.44415 has 4 digits 70.4441, as its product is 704441.4999; Spark rounds the decimal form."""
    return (F.round(F.col(score) * 10_000, 0) / 10_000).alias("score")


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("query_id", "doc_id", four_places("score"), "rank")


def token_postings_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = postings(_t(spark, sf_dir, "documents"), "doc_id", "text").groupBy("token").agg(F.sum("tf").alias("cf"), F.count("*").alias("df"))
    return found.orderBy(F.desc("cf"), "token").limit(100)


def doc_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings(_t(spark, sf_dir, "documents"), "doc_id", "text").groupBy("token").agg(F.count("*").alias("df"))


def doc_length_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents")
    lengths = postings(docs, "doc_id", "text").groupBy("doc_id").agg(F.sum("tf").alias("dl"))
    length = F.greatest(F.coalesce("dl", F.lit(0)), F.lit(1))
    return docs.select("doc_id", "lang").join(lengths, "doc_id", "left").groupBy("lang").agg(F.count("*").alias("n"), F.sum(length).cast("long").alias("total"), F.round(F.avg(length.cast("double")), 4).alias("avg_length"))


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_lexical(spark, sf_dir, 5))


def bm25_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ranking.search(_t(spark, sf_dir, "documents"), _terms(spark, sf_dir), 5, wanted=F.lower("lang").isin("fr", "de"))
    return _rounded(r.top_k(found, 5))


def bm25_field_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _t(spark, sf_dir, "pages").select(F.col("page_id").alias("query_id"), "url", "html")
    terms = r.query_terms(_queries(spark, sf_dir).join(pages, "query_id"), {"query": "query", "path": "url", "code": "html"}, STOP)
    return _rounded(r.top_k(ranking.search(_t(spark, sf_dir, "documents"), terms, 5), 5))


def low_signal_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = postings(_t(spark, sf_dir, "documents"), "doc_id", "text")
    return found.groupBy("doc_id").agg(F.count("*").alias("n_terms"), F.count_if(~F.col("token").isin(STOP)).alias("n_signal"))


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    vectors = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("v"))
    return vectors, vectors.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.col("v").alias("q"))


def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = nearest(*_vectors(spark, sf_dir), 10).select("query_id", "doc_id", F.col("sim").alias("score"))
    return r.top_k(found, 10, floor=0.0)


def cosine_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.semantic(*_vectors(spark, sf_dir), 0.28).where("query_id <> doc_id").select("query_id", "doc_id", F.round("sim", 6).alias("sim"))


def _similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors, queries = _vectors(spark, sf_dir)
    items = _t(spark, sf_dir, "benchmark").select((F.col("item_id") * 100).alias("query_id"))
    return r.semantic(vectors, queries.join(items, "query_id", "left_semi"), 0.28).select((F.col("query_id") / 100).cast("long").alias("query_id"), "doc_id", "sim")


def hybrid_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(r.top_k(ranking.blended(_t(spark, sf_dir, "documents"), _terms(spark, sf_dir), _similar(spark, sf_dir), 10), 10))


def direct_union_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark passage word for word are direct results, however many."""
    found = ranking.search(_t(spark, sf_dir, "documents"), _terms(spark, sf_dir), 5, passages=_queries(spark, sf_dir))
    direct = found.where("direct").select("query_id", "doc_id", "score")
    ranked = r.top_k(found.where("NOT direct"), 5).select("query_id", "doc_id", "score")
    return r.direct_first(direct, ranked, 5).select("query_id", "doc_id", four_places("score"), "origin", "place")


def id_trigger_bonus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bonuses: 12 if the text names the source, 2.5 for each trigger word that stands in it (repeats count)."""
    triggers = F.array(F.lit("the"), F.col("lang"), F.lit("token"), F.lit("token"))
    hits = F.size(r.trigger_hits(triggers, F.lower("text")))
    return _t(spark, sf_dir, "documents").select("doc_id", hits.cast("long").alias("hits"), (r.id_bonus(F.lower("text"), F.col("source")) + hits * r.TRIGGER_BONUS).alias("bonus"))


def _rule_rows(docs: DataFrame) -> DataFrame:
    """Documents as rules: the id is source and number, title and statement are lines, triggers two words, the severity follows the number."""
    line = F.element_at(F.split("text", "\n"), 1)
    severity = F.when(F.col("doc_id") % 3 == 0, "blocker").when(F.col("doc_id") % 3 == 1, "major").otherwise("advisory")
    rules = docs.select(
        "doc_id", F.concat_ws("-", "source", "doc_id").alias("id"), F.col("source").alias("original_id"), F.substring(line, 1, 40).alias("title"), F.col("text").alias("statement"), F.col("lang").alias("section"), severity.alias("severity"),
        F.array(F.element_at(F.split(line, "[ .,]"), 1), F.col("lang")).alias("triggers"),
    )
    return normalised(rules, ["id", "title", "statement", "section"])


def _fields() -> dict:
    return {"id": F.col("id"), "title": F.col("title"), "statement": F.col("statement"), "section": F.col("section"), "triggers": F.array_join("triggers", " ")}


def rule_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole scoring: weighted fields, BM25, id and trigger bonuses, severity before id among ties, floor, limit, explanations."""
    docs, pages = _t(spark, sf_dir, "documents"), _t(spark, sf_dir, "pages").select(F.col("page_id").alias("query_id"), F.col("url").alias("path"), F.lit("").alias("code"))
    queries = _queries(spark, sf_dir).join(pages, "query_id")
    terms = r.query_terms(queries, {"query": "query", "path": "path"}, STOP)
    found = ranking.search_rules(_rule_rows(docs), _fields(), queries, terms, 5)
    few = stored(_rule_rows(docs.join(broadcast_if_small(found.select("doc_id").distinct()), "doc_id", "left_semi")), "few")
    ranked = r.top_k(found.join(few.select("doc_id", "id", "severity", "triggers"), "doc_id"), 5, ties=[r.severity_rank(F.col("severity")), "id"])
    shown = r.explain(r.build_field_index(few, _fields()), terms, r.with_hits(ranked, queries))
    return shown.select("query_id", "id", four_places("score"), "severity", "rank", F.array_join("hits", ",").alias("trigger_hits"), F.array_join("query_matches", ",").alias("query_matches"), F.array_join("path_matches", ",").alias("path_matches"))


def stored_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 from an index that is stored once, with its manifest checked, and read back; only the queries' buckets of postings are read."""
    path = shared_path(spark, "index")
    bundles.write_index(ranking.index_to_store(_t(spark, sf_dir, "documents"), [(F.col("text"), 1)]), path, "v1", "0" * 64)
    found = ranking.search_index(lambda tokens: bundles.read_index(spark, path, "v1", "0" * 64, tokens), _terms(spark, sf_dir), 5)
    return _rounded(r.top_k(found, 5))


def index_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of a stored index, as validated on reading: schema, version, bundle and row count."""
    path = shared_path(spark, "index")
    bundles.write_index(r.build_index(_t(spark, sf_dir, "benchmark"), "item_id"), path, "v1", "f" * 64)
    bundles.read_index(spark, path, "v1", "F" * 64)
    return bundles.manifest(spark, path)


QUERIES = {f.__name__: f for f in (bm25_topk, token_postings_top, doc_frequency, doc_length_avg, bm25_scoped, bm25_field_weighted, low_signal_filter, cosine_topk, cosine_threshold, hybrid_blend, direct_union_ranked, id_trigger_bonus, rule_search, stored_index_topk, index_metadata)}


def _post(table: str, key: str, text: str) -> str:
    """Postings of a table in SQL."""
    return f"""SELECT doc_id, token, count(*) AS tf FROM (
      SELECT doc_id, unnest(list_concat([lower(o)], list_filter(string_split_regex(lower(regexp_replace(o, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[.\\-/:\\\\_$@*\\s]+'), lambda x: x <> ''))) AS token
      FROM (SELECT {key} AS doc_id, unnest(regexp_extract_all({text}, '{TOKEN}')) AS o FROM {table})) GROUP BY doc_id, token"""


_P = f"p AS ({_post('documents', 'doc_id', 'text')})"
_STATS = f"""{_P}, dl AS (SELECT doc_id, sum(tf) AS dl FROM p GROUP BY doc_id), dfs AS (SELECT token, count(*) AS df FROM p GROUP BY token),
  tot AS (SELECT count(*) AS n, avg(greatest(coalesce(dl, 0), 1)::double) AS avgdl FROM documents LEFT JOIN dl USING (doc_id))"""
_SCORED = """s AS (SELECT query_id, doc_id, round_even(sum(w * ln(1e0 + (n - df + 0.5e0) / (df + 0.5e0)) * tf * 2.5e0 / (tf + 1.5e0 * (0.25e0 + 0.75e0 * dl / greatest(avgdl, 1e0)))), 6) AS score
  FROM p JOIN q USING (token) JOIN dfs USING (token) JOIN dl USING (doc_id), tot GROUP BY query_id, doc_id)"""
_Q = f"q AS (SELECT doc_id AS query_id, token, 3e0 AS w FROM ({_post('benchmark', 'item_id', 'text')}))"


def _top(source: str, k: int, floor: str = "0.22e0") -> str:
    return f"""SELECT query_id, doc_id, round(score, 4) AS score, rank FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS best,
      row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM {source}) WHERE rank <= {k} AND score >= greatest(0, best * {floor})"""


_COS = "SELECT a.vec_id AS query_id, b.vec_id AS doc_id, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) AS sim FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0"
_STOPS = ", ".join(f"'{w}'" for w in STOP)
_FIELDS = " UNION ALL ".join(f"SELECT query_id, token, {w} AS w FROM (SELECT doc_id AS query_id, token FROM ({_post(t, k, c)})) WHERE query_id IN (SELECT item_id FROM benchmark) AND query_id IN (SELECT page_id FROM pages) AND token NOT IN ({_STOPS})" for t, k, c, w in (("benchmark", "item_id", "text", "3e0"), ("pages", "page_id", "url", "2e0"), ("pages", "page_id", "html", "1e0")))
_RULES = """rl AS (SELECT *, source || '-' || doc_id AS id, string_split(text, chr(10))[1] AS line, CASE doc_id % 3 WHEN 0 THEN 'blocker' WHEN 1 THEN 'major' ELSE 'advisory' END AS severity FROM documents),
  rr AS (SELECT doc_id, id, source, text, lang, severity, substr(line, 1, 40) AS title, [string_split_regex(line, '[ .,]')[1], lang] AS triggers FROM rl)"""
_FIELD = " UNION ALL ".join(f"SELECT doc_id, token, tf * {n} AS tf FROM ({_post('rr', 'doc_id', c)})" for c, n in (("id", 5), ("title", 4), ("text", 3), ("lang", 1), ("array_to_string(triggers, ' ')", 5)))
_RULE_Q = f"""qt AS (SELECT item_id AS query_id, text AS query, url AS path FROM benchmark JOIN pages ON page_id = item_id),
  qs AS (SELECT query_id, token, 3e0 AS w, 'q' AS k FROM (SELECT doc_id AS query_id, token FROM ({_post('qt', 'query_id', 'query')})) WHERE token NOT IN ({_STOPS}) UNION ALL SELECT query_id, token, 2e0, 'p' FROM (SELECT doc_id AS query_id, token FROM ({_post('qt', 'query_id', 'path')})) WHERE token NOT IN ({_STOPS})),
  q AS (SELECT query_id, token, sum(w) AS w FROM qs GROUP BY query_id, token)"""
_FIRSTS = lambda column: f"flatten(list_transform(regexp_extract_all({column}, '{TOKEN}'), lambda o: list_concat([lower(o)], list_filter(string_split_regex(lower(regexp_replace(o, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[.\\-/:\\\\_$@*\\s]+'), lambda x: x <> ''))))"
ORACLES = {
    "rule_search": f"""WITH {_RULES}, p AS (SELECT doc_id, token, sum(tf) AS tf FROM ({_FIELD}) GROUP BY doc_id, token), dl AS (SELECT doc_id, sum(tf) AS dl FROM p GROUP BY doc_id), dfs AS (SELECT token, count(*) AS df FROM p GROUP BY token),
      tot AS (SELECT count(*) AS n, avg(greatest(coalesce(dl, 0), 1)::double) AS avgdl FROM documents LEFT JOIN dl USING (doc_id)), {_RULE_Q},
      raw AS (SELECT query_id, doc_id, sum(w * ln(1e0 + (n - df + 0.5e0) / (df + 0.5e0)) * tf * 2.5e0 / (tf + 1.5e0 * (0.25e0 + 0.75e0 * dl / greatest(avgdl, 1e0)))) AS score FROM p JOIN q USING (token) JOIN dfs USING (token) JOIN dl USING (doc_id), tot GROUP BY query_id, doc_id),
      b AS (SELECT *, list_filter(triggers, lambda t: t <> '' AND (contains(lower(query), lower(t)) OR contains(lower(path), lower(t)))) AS hits FROM raw JOIN rr USING (doc_id) JOIN qt USING (query_id)),
      s AS (SELECT *, round_even(score + CASE WHEN contains(lower(query), lower(id)) OR contains(lower(query), lower(source)) THEN 12e0 ELSE 0e0 END + 2.5e0 * len(hits), 6) AS total FROM b),
      k AS (SELECT *, max(total) OVER (PARTITION BY query_id) AS best, row_number() OVER (PARTITION BY query_id ORDER BY total DESC, list_position(['blocker', 'major', 'advisory'], severity), id) AS rank FROM s),
      t AS (SELECT * FROM k WHERE rank <= 5 AND total >= best * 0.22e0),
      o AS (SELECT query_id, {_FIRSTS('query')} AS oq, {_FIRSTS('path')} AS op FROM qt),
      m AS (SELECT t.query_id, t.doc_id, list(p.token ORDER BY list_position(oq, p.token)) FILTER (k = 'q') AS mq, list(p.token ORDER BY list_position(op, p.token)) FILTER (k = 'p') AS mp FROM t JOIN p USING (doc_id) JOIN qs ON qs.query_id = t.query_id AND qs.token = p.token JOIN o ON o.query_id = t.query_id GROUP BY ALL)
      SELECT query_id, id, round(total, 4) AS score, severity, rank, array_to_string(hits, ',') AS trigger_hits, coalesce(array_to_string(mq[:8], ','), '') AS query_matches, coalesce(array_to_string(mp[:6], ','), '') AS path_matches FROM t JOIN m USING (query_id, doc_id)""",
    "stored_index_topk": f"WITH {_STATS}, {_Q}, {_SCORED} {_top('s', 5)}",
    "index_metadata": "SELECT 1 AS schema_version, 'v1' AS policy_version, repeat('f', 64) AS bundle_id, 64 AS buckets, count(*) AS rule_count FROM benchmark",
    "bm25_topk": f"WITH {_STATS}, {_Q}, {_SCORED} {_top('s', 5)}",
    "token_postings_top": f"WITH {_P} SELECT token, sum(tf)::bigint AS cf, count(*) AS df FROM p GROUP BY token ORDER BY cf DESC, token LIMIT 100",
    "doc_frequency": f"WITH {_P} SELECT token, count(*) AS df FROM p GROUP BY token",
    "doc_length_avg": f"WITH {_P}, dl AS (SELECT doc_id, sum(tf) AS dl FROM p GROUP BY doc_id) SELECT lang, count(*) AS n, sum(greatest(coalesce(dl, 0), 1))::bigint AS total, round(avg(greatest(coalesce(dl, 0), 1)::double), 4) AS avg_length FROM documents LEFT JOIN dl USING (doc_id) GROUP BY lang",
    "bm25_scoped": f"WITH {_STATS}, {_Q}, {_SCORED}, f AS (SELECT s.* FROM s JOIN documents USING (doc_id) WHERE lower(lang) IN ('fr', 'de')) {_top('f', 5)}",
    "bm25_field_weighted": f"WITH {_STATS}, q AS (SELECT query_id, token, sum(w) AS w FROM ({_FIELDS}) GROUP BY query_id, token), {_SCORED} {_top('s', 5)}",
    "low_signal_filter": f"WITH {_P} SELECT doc_id, count(*) AS n_terms, count(*) FILTER (token NOT IN ({_STOPS})) AS n_signal FROM p GROUP BY doc_id",
    "cosine_topk": f"SELECT query_id, doc_id, score, rank FROM (SELECT query_id, doc_id, round(sim, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 6) DESC, doc_id) AS rank FROM ({_COS}) WHERE query_id <> doc_id) WHERE rank <= 10 AND score >= 0",
    "cosine_threshold": f"SELECT query_id, doc_id, round(sim, 6) AS sim FROM ({_COS}) WHERE query_id <> doc_id AND sim >= 0.28e0",
    "hybrid_blend": f"WITH {_STATS}, {_Q}, {_SCORED}, v AS (SELECT query_id // 100 AS query_id, doc_id, sim FROM ({_COS}) WHERE sim >= 0.28e0 AND query_id // 100 IN (SELECT item_id FROM benchmark)), h AS (SELECT query_id, doc_id, coalesce(score, 0) + 0.4e0 * 8e0 * greatest(0e0, round_even(coalesce(sim, 0e0), 6)) AS score FROM s FULL JOIN v USING (query_id, doc_id)) {_top('h', 10)}",
    "direct_union_ranked": f"""WITH {_STATS}, {_Q}, {_SCORED}, d AS (SELECT query_id, doc_id, score FROM s JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = query_id WHERE contains(d.text, b.text)),
      r AS (SELECT query_id, doc_id, score FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS best, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 5 AND score >= best * 0.22e0),
      u AS (SELECT *, 'direct' AS origin FROM d UNION ALL SELECT *, 'ranked' FROM r WHERE (query_id, doc_id) NOT IN (SELECT (query_id, doc_id) FROM d)),
      o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY origin, score DESC, doc_id) AS place FROM u)
      SELECT query_id, doc_id, round(score, 4) AS score, origin, place FROM o WHERE origin = 'direct' OR place <= 5""",
    "id_trigger_bonus": "SELECT doc_id, hits, (CASE WHEN contains(lower(text), lower(source)) THEN 12e0 ELSE 0e0 END + hits * 2.5e0) AS bonus FROM (SELECT *, len(list_filter(['the', lang, 'token', 'token'], lambda x: contains(lower(text), x))) AS hits FROM documents)",
}
