"""Registered bundle queries: documents as rules, events as sessions, lexical results as cards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.shared import shared_path
from ..operators import bundles as b
from ..sources import markdown
from .extraction import _REQ, _STD, _standards
from .retrieval import _Q, _SCORED, _STATS, _lexical


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def core_rules_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 40 core rules: languages are scopes, lengths severities, labels mark some as core or not."""
    severity = F.when(F.col("n_chars") > 4000, "blocker").when(F.col("n_chars") > 1000, "major").otherwise("advisory")
    scope = F.when(F.col("lang") == "en", "project").when(F.col("lang") == "fr", "company").otherwise("department")
    marked = _t(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 1, True).when(F.col("quality") == 0, False).alias("core"))
    rules = _t(spark, sf_dir, "documents").select("doc_id", severity.alias("severity"), scope.alias("scope")).join(marked, "doc_id", "left").withColumnRenamed("doc_id", "rule_id")
    return b.core_rules(rules).select("rule_id", "severity", "scope", F.coalesce("core", F.lit(False)).alias("core"))


def context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = _lexical(spark, sf_dir, 5).select("query_id", "doc_id", "rank")
    cards = ranked.join(_t(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return b.within_budget(cards, 6000).select("query_id", "doc_id", "rank", F.col("used").cast("long").alias("used"))


def user_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session summaries of the event log: each event is a check whose result is its type, on the file k modulo 7."""
    k = F.get_json_object("props", "$.k").cast("int")
    status = F.when(F.col("event_type") == "error", "fail").when(F.col("event_type") == "purchase", "pass").otherwise("review")
    result = F.struct(F.concat(F.lit("R"), (k % 5).cast("string")).alias("rule_id"), F.lit("c").alias("checker"), status.alias("status"), F.concat(F.lit("f"), (k % 7).cast("string")).alias("path"), (F.col("value") > 5).alias("blocking"))
    events = _t(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("event_id"), F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss").alias("timestamp"), F.lit("post_write_check").alias("event"), F.concat(F.lit("f"), (k % 7).cast("string")).alias("path"), F.array(F.concat(F.lit("R"), (k % 5).cast("string"))).alias("matched_rule_ids"), F.array(result).alias("results"))
    found = b.session_summary(events)
    return found.select("session_id", "events", F.array_join("changed_files", ",").alias("files"), F.array_join("matched_rule_ids", ",").alias("rules"), F.array_join("failed_rule_ids", ",").alias("failed"), "blocking_failures", F.size(F.coalesce("resolved", F.array())).cast("long").alias("n_resolved"), F.size(F.coalesce("unresolved", F.array())).cast("long").alias("n_unresolved"))


def core_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The core rules as one Markdown text."""
    severity = F.when(F.col("n_chars") > 4000, "blocker").otherwise("major")
    rules = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("rule_id"), F.substring("text", 1, 30).alias("statement"), severity.alias("severity"), F.lit("company").alias("scope"), F.lit(None).cast("boolean").alias("core"))
    return b.core_block(rules, 15)


def rule_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("title"), F.substring("text", 1, 50).alias("statement"), F.when(F.col("doc_id") % 2 == 0, "blocker").alias("severity"), F.when(F.col("doc_id") % 3 == 0, "").otherwise("api").alias("category"), F.when(F.col("doc_id") % 5 > 0, F.col("source")).alias("document"), F.when(F.col("doc_id") % 7 > 0, F.col("lang")).otherwise("").alias("section"))
    return b.cards(rules)


def rendered_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context texts under a budget: the first three documents of each source and language as its cards."""
    by = Window.partitionBy("source", "lang").orderBy("doc_id")
    rows = _t(spark, sf_dir, "documents").withColumn("rank", F.row_number().over(by)).where("rank <= 3")
    cards = rows.select(F.concat_ws("/", "source", "lang").alias("query_id"), "rank", F.col("doc_id").cast("string").alias("id"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("level"), F.regexp_replace("text", r"\s", "_").alias("statement"), "source", F.when(F.col("doc_id") % 3 > 0, F.regexp_replace("text", r"\s", "-")).alias("description"), F.lit("").alias("negative"), F.col("lang").alias("positive"))
    return b.context(cards, 1500).select("query_id", "n_cards", F.sha2("text", 256).alias("text_sha256"), F.length("text").cast("long").alias("n"))


def import_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents offered for import: their scopes and names follow source, language and number; what pages hold exists already."""
    scope = F.when(F.col("lang") == "en", "Company").when(F.col("lang") == "fr", "project").when(F.col("lang") == "de", "department").otherwise("other")
    name = F.concat(F.col("source"), F.when(F.col("doc_id") % 11 == 0, "/").otherwise("-"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 5 == 0, ".txt").when(F.col("doc_id") % 5 == 1, ".MD").otherwise(".md"))
    offered = _t(spark, sf_dir, "documents").select("doc_id", scope.alias("scope"), name.alias("name"), "text")
    existing = offered.where("doc_id % 13 = 0").select(F.upper("scope").alias("scope"), F.upper("name").alias("name"))
    return markdown.import_problems(offered, existing, 8000).select("doc_id", "problem")


def activated_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From documents to an active bundle and back: extraction, review sections with marks, strict decisions, fingerprint, index, checked reading."""
    work, live = shared_path(spark, "work"), shared_path(spark, "live")
    found = b.prepare(_standards(spark, sf_dir), None, None, work)
    box = F.when(F.col("document") < "std/src2", "approved").otherwise("rejected")
    marked = spark.read.parquet(f"{work}/review").withColumn("markdown", F.replace("markdown", F.concat(F.lit("- [ ] "), box), F.concat(F.lit("- [x] "), box)))
    b.activate(found, b.parse_sections(marked), live, "v1")
    return b.read_bundle(spark, live).rules.groupBy("document", "severity").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (core_rules_topk, context_budget, user_summary, core_block, rule_cards, rendered_context, import_checks, activated_bundle)}
_CUT = lambda text, most: f"CASE WHEN length({text}) > {most} THEN rtrim(substr({text}, 1, ({most} - 1)::int), ' ') || '…' ELSE {text} END"
ORACLES = {
    "core_block": "SELECT '## Core rules' || chr(10) || chr(10) || string_agg('- `' || doc_id || '`: ' || s, chr(10) ORDER BY doc_id) || chr(10) AS markdown FROM (SELECT doc_id, substr(text, 1, 30) AS s FROM documents WHERE n_chars > 4000 ORDER BY doc_id LIMIT 15)",
    "rule_cards": "SELECT doc_id AS id, lang AS title, substr(text, 1, 50) AS statement, CASE WHEN doc_id % 2 = 0 THEN 'blocker' ELSE 'major' END AS severity, CASE WHEN doc_id % 3 = 0 THEN 'coding' ELSE 'api' END AS category, concat_ws(' / ', CASE WHEN doc_id % 5 > 0 THEN source END, CASE WHEN doc_id % 7 > 0 THEN lang END) AS source FROM documents",
    "rendered_context": f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS rank FROM documents), c AS (SELECT *, count(*) OVER (PARTITION BY source, lang) AS n FROM r WHERE rank <= 3),
      s AS (SELECT *, least(3200, greatest(520, 800 // n)) AS share, regexp_replace(text, '\\s', '_', 'g') AS st, CASE WHEN doc_id % 3 > 0 THEN nullif(regexp_replace(text, '\\s', '-', 'g'), '') END AS de FROM c),
      k AS (SELECT *, {_CUT('st', 'least(600, greatest(180, share // 4))')} AS sc, ' (' || source || ')' AS suffix FROM s),
      f AS (SELECT *, greatest(100, greatest(0, share - length(sc) - length(suffix) - 80) // (1 + (de IS NOT NULL)::int)) AS room FROM k),
      t AS (SELECT source || '/' || lang AS query_id, rank, '- [' || doc_id || ']' || CASE WHEN doc_id % 2 = 0 THEN ' ' || lang ELSE '' END || ' ' || sc || suffix || coalesce(chr(10) || '  description: ' || {_CUT('de', 'room')}, '') || chr(10) || '  positive: ' || lang AS line FROM f),
      w AS (SELECT query_id, count(*) AS n_cards, string_agg(line, chr(10) ORDER BY rank) AS text FROM t GROUP BY query_id)
      SELECT query_id, n_cards, sha256({_CUT('text', '1500')}) AS text_sha256, length({_CUT('text', '1500')}) AS n FROM w""",
    "import_checks": """SELECT doc_id, CASE WHEN lang NOT IN ('en', 'fr', 'de') THEN 'unknown scope' WHEN doc_id % 11 = 0 THEN 'not a plain file name' WHEN doc_id % 5 = 0 THEN 'not a Markdown file' WHEN trim(text, ' ') = '' THEN 'empty' WHEN strlen(text) > 8000 THEN 'too large' WHEN contains(text, '<!-- rule ') THEN 'a review document' WHEN doc_id % 13 = 0 THEN 'exists' END AS problem FROM documents""",
    "activated_bundle": f"""WITH {_STD}, u AS (SELECT document, CASE WHEN doc_id % 2 = 0 THEN 'advisory' WHEN {_REQ} THEN 'major' ELSE 'advisory' END AS severity FROM c UNION ALL SELECT document, 'major' FROM c)
      SELECT document, severity, count(*) AS n FROM u WHERE document < 'std/src2' GROUP BY document, severity""",
    "core_rules_topk": """WITH r AS (SELECT doc_id AS rule_id, CASE WHEN n_chars > 4000 THEN 'blocker' WHEN n_chars > 1000 THEN 'major' ELSE 'advisory' END AS severity,
        CASE lang WHEN 'en' THEN 'project' WHEN 'fr' THEN 'company' ELSE 'department' END AS scope, CASE WHEN toxic = 1 THEN true WHEN quality = 0 THEN false END AS mark FROM documents LEFT JOIN labels USING (doc_id))
      SELECT rule_id, severity, scope, coalesce(mark, false) AS core FROM r WHERE coalesce(mark, false) OR (mark IS NULL AND severity = 'blocker' AND scope <> 'project')
      ORDER BY coalesce(mark, false) DESC, list_position(['blocker', 'major', 'advisory'], severity), list_position(['company', 'department', 'project'], scope), rule_id LIMIT 40""",
    "context_budget": f"""WITH {_STATS}, {_Q}, {_SCORED}, t AS (SELECT query_id, doc_id, rank FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS best, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 5 AND score >= best * 0.22e0)
      SELECT * FROM (SELECT query_id, doc_id, rank, (sum(length(text)) OVER (PARTITION BY query_id ORDER BY rank))::bigint AS used FROM t JOIN documents USING (doc_id)) WHERE used <= 6000""",
    "user_summary": """WITH e AS (SELECT user_id AS session_id, event_id, ts, (props->>'$.k')::int AS k, event_type, value FROM events),
      h AS (SELECT session_id, count(*) AS events, array_to_string(list_sort(list(DISTINCT 'f' || k % 7)), ',') AS files, array_to_string(list_sort(list(DISTINCT 'R' || k % 5)), ',') AS rules,
        coalesce(array_to_string(list_sort(list(DISTINCT 'R' || k % 5) FILTER (event_type = 'error')), ','), '') AS failed, count(*) FILTER (event_type = 'error' AND value > 5) AS blocking_failures FROM e GROUP BY session_id),
      l AS (SELECT session_id, arg_max(event_type, (date_trunc('second', ts), event_id)) AS last, bool_or(event_type = 'error') AS failed FROM e GROUP BY session_id, k % 5, k % 7),
      c AS (SELECT session_id, count(*) FILTER (failed AND last = 'purchase') AS n_resolved, count(*) FILTER (last = 'error') AS n_unresolved FROM l GROUP BY session_id) SELECT * FROM h JOIN c USING (session_id)""",
}
