"""Registered extraction queries: lexicons are drawn from the words that the documents hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions.text import folded, normalised, rule_id, strip_markup, title
from ..operators import extraction as x



def _word(*words: str) -> str:
    """Any of the words between spaces, stops and line ends."""
    return f"(?:^|[ .,])(?:{'|'.join(words)})(?:[ .,]|$)"


LEXICON = x.Lexicon(
    normative=_word("the", "der", "les", "los"), strong=_word("was", "nicht", "pas"), required=_word("with", "von", "pour"), advisory=_word("by", "mit", "sur"), code=r"`[^`]+`|@[A-Z]|[A-Za-z0-9]\.[A-Za-z0-9]",
    categories={"security": ("token", "password"), "performance": ("tion",), "project": ("eau", "src1"), "testing": ("ung", "ción")},
)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line of each document is a statement."""
    return _docs(spark, sf_dir).select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("line", "statement"))


def doc_scan_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).groupBy("source", "lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


def normative_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("statement")
    kind = x.category(F.col("source"), s, LEXICON)
    rated = _lines(spark, sf_dir).where(s.rlike(f"(?i){LEXICON.normative}")).withColumn("category", kind)
    return rated.select("doc_id", F.col("line").cast("long").alias("line"), "category", x.severity(s, F.col("category"), LEXICON).alias("severity"), x.confidence(s, s, F.lit(False), F.col("source"), LEXICON).alias("confidence"))


def statement_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = x.first_of_each(_lines(spark, sf_dir), ["source"], "statement", ["doc_id", "line"])
    return found.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.col("doc_id") * 1000 + F.col("line")).alias("checksum"))


def _standards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as Markdown standards: every document is a structured rule with a shared code (its number modulo 50), fields from its lines, and a list item."""
    lines = F.split("text", "\n")
    line = lambda i: F.coalesce(F.get(lines, F.lit(i)), F.lit(""))
    code = F.concat(F.lit("G."), F.upper("lang"), F.lit("."), (F.col("doc_id") % 50).cast("string"))
    parts = [
        F.concat(F.lit("# "), "source"), F.concat(F.lit("### "), F.col("doc_id").cast("string"), F.lit(".1 "), code, F.lit(" T "), F.substring(F.regexp_replace(line(0), "[^A-Za-z ]", ""), 1, 30), F.lit(" x")),
        F.concat(F.lit("【级别】 "), F.when(F.col("doc_id") % 2 == 0, "建议").otherwise("要求")), F.lit("【描述】"), F.lit("D"), F.lit("#### deeper"), F.lit("【反例】"), F.lit("```java"), F.concat(F.lit("# no heading "), F.col("lang")), F.lit("```"), F.lit("【正例】 ok"),
        F.lit("## Notes"), F.concat(F.lit("- must "), F.substring(F.regexp_replace(line(0), "[^A-Za-z ]", ""), 1, 40), F.lit(" e")),
    ]
    return _docs(spark, sf_dir).where("doc_id is not null").select("doc_id", F.concat_ws("\n", *parts).alias("text"), F.concat(F.lit("std/"), "source", F.lit(".md")).alias("source"))


def structured_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = x.extract(_standards(spark, sf_dir)).where("number <> ''")
    return found.select("doc_id", "rule_id", "section", "line_start", "line_end", "severity", "confidence", "title", "description", "negative", "positive", F.array_join("enforcement", ",").alias("enforcement"), F.array_join("tags", ",").alias("tags"))


def structured_and_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of both kinds: lines that a structured rule covers give no prose candidate."""
    return x.extract(_standards(spark, sf_dir)).groupBy("document", F.when(F.col("number") != "", "structured").otherwise("prose").alias("kind"), "severity").agg(F.count("*").alias("n"), F.sum("line_start").alias("lines"))


def qualified_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes that several documents use become ``document::code``; those a document uses twice get its hash, then the rule's own."""
    rules = _docs(spark, sf_dir).where("doc_id is not null").select(
        F.concat(F.lit("G."), F.upper("lang"), F.lit("."), (F.col("doc_id") % 97).cast("string")).alias("rule_id"), F.concat(F.lit("std/"), "source", F.lit(".md")).alias("document"), F.col("lang").alias("section"), F.col("doc_id").alias("line_start"), F.substring("text", 1, 20).alias("statement"), "doc_id",
    )
    return x.qualify_ids(rules).select("doc_id", "rule_id", "original_id")


def trigger_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dotted names, annotations and calls of each document, its letters reduced to ASCII first so that word bounds are the same everywhere."""
    plain = F.regexp_replace("text", r"[^\x00-\x7F]", "")
    return _docs(spark, sf_dir).select("doc_id", F.array_join(F.array_sort(lx.trigger_terms(plain)), " ").alias("terms"), F.array_join(lx.enforcement(plain), ",").alias("enforcement"))


def search_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search words that intents add, with needles from the documents' own words."""
    groups = ((("theth", "queel"), ("A", "B")), (("erander",), ("B", "C")), (("ofthe",), ("D",)))
    return _docs(spark, sf_dir).select("doc_id", F.array_join(lx.retrieval_hints(F.col("text"), groups), ",").alias("hints"))


def nfkc_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised and case-folded texts; the given tables are in NFKC form already, so SQL can check them."""
    return folded(normalised(_docs(spark, sf_dir).select("doc_id", "text"), ["text"]), "text", "low").select("doc_id", F.length("low").cast("long").alias("n"), F.sha2(F.regexp_replace("text", r"\s+", ""), 256).alias("sha"))


def title_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", title(F.concat_ws(" / ", "lang", "source"), F.element_at(F.split("text", "\n"), 1)).alias("title"))


def strip_markup_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("id"), strip_markup(F.col("html")).alias("plain"))
    docs = _docs(spark, sf_dir).select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), strip_markup(F.col("text")).alias("plain"))
    return pages.unionByName(docs).select("id", F.sha2("plain", 256).alias("plain_sha256"), F.length("plain").cast("long").alias("n"))


def rule_id_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", rule_id(F.lit("auto"), F.col("source"), F.concat_ws(" ", "lang", "source"), F.col("text")).alias("rule_id"))


def id_collision_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = _docs(spark, sf_dir).select("doc_id", F.concat_ws("::", "source", F.substring("text", 1, 4)).alias("id"))
    return x.collisions(rules, "id", ["doc_id"]).select("doc_id", "id", "n_same", F.col("place").cast("long").alias("place"))


def extract_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return x.extract(_docs(spark, sf_dir), LEXICON)


QUERIES = {f.__name__: f for f in (doc_scan_count, normative_flags, statement_dedupe, title_truncate, strip_markup_text, rule_id_hash, id_collision_groups, extract_markdown, structured_rules, structured_and_prose, qualified_ids, trigger_terms, search_hints, nfkc_fold)}
_SCORES = [(label, " + ".join(f"(3 * contains(lower(source), '{t}')::int + contains(lower(source || ' ' || statement), '{t}')::int)" for t in terms)) for label, terms in LEXICON.categories.items()]
_BEST = "greatest(" + ", ".join(f"s_{label}" for label, _ in _SCORES) + ")"
_CATEGORY = f"CASE WHEN {_BEST} = 0 THEN 'coding' " + " ".join(f"WHEN s_{label} = {_BEST} THEN '{label}'" for label, _ in _SCORES) + " END"
_M = lambda p: f"regexp_matches(statement, '(?i){p}')"
_STRIP = "{0}"
for _pattern, _new in ((r"<!--.*?-->", " "), (r"!\[([^\]]*)\]\([^)]+\)", r"\1"), (r"\[([^\]]+)\]\([^)]+\)", r"\1"), (r"<https?://[^>]+>", " "), (r"[`*_~]", ""), (r"^\s*>+\s?", ""), (r"\s*\|\s*", "；"), (r"^[； ]+|[； ]+$", ""), (r"\s+", " ")):
    _STRIP = f"regexp_replace({_STRIP}, '{_pattern}', '{_new}', 'g')"
_STRIP = f"trim({_STRIP}, ' ')"
_LINES = "l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS statement, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents)"
_STD = """w AS (SELECT *, regexp_replace(substr(regexp_replace(string_split(text, chr(10))[1], '[^A-Za-z ]', '', 'g'), 1, 30), '\\s+', ' ', 'g') AS s FROM documents),
  c AS (SELECT doc_id, lang, source, 'std/' || source || '.md' AS document, 'G.' || upper(lang) || '.' || (doc_id % 50) AS code, regexp_replace('T ' || s || ' x', '\\s+', ' ', 'g') AS title FROM w)"""
_NAME = r"[A-Za-z_$][\w$]*"
_REQ = "regexp_matches(title, '(?i)must|shall|required')"
ORACLES = {
    "doc_scan_count": "SELECT source, lang, count(*) AS n, sum(n_chars)::bigint AS chars FROM documents GROUP BY source, lang",
    "normative_flags": f"""WITH {_LINES}, s AS (SELECT *, {', '.join(f'{e} AS s_{label}' for label, e in _SCORES)} FROM l WHERE {_M(LEXICON.normative)}), c AS (SELECT *, {_CATEGORY} AS category FROM s)
      SELECT doc_id, line::bigint AS line, category, CASE WHEN {_M(LEXICON.strong)} THEN 'blocker' WHEN {_M(LEXICON.required)} THEN 'major' WHEN category = 'security' AND NOT {_M(LEXICON.advisory)} THEN 'major' ELSE 'advisory' END AS severity,
      (60 + 12 * ({_M(LEXICON.strong)} OR {_M(LEXICON.required)})::int + 8 * {_M(LEXICON.code)}::int - 8 * (length(statement) < 12 OR length(statement) > 400)::int) / 100e0 AS confidence FROM c""",
    "statement_dedupe": f"""WITH {_LINES}, k AS (SELECT *, lower(regexp_replace(statement, '\\s+', '', 'g')) AS key FROM l), f AS (SELECT source, key, min((doc_id, line)) AS m FROM k WHERE length(key) >= 5 GROUP BY source, key)
      SELECT source, count(*) AS n, sum(m[1] * 1000 + m[2])::bigint AS checksum FROM f GROUP BY source""",
    "title_truncate": "SELECT doc_id, substr(CASE WHEN contains(t, source) THEN t ELSE source || '：' || t END, 1, 80) AS title FROM (SELECT *, CASE WHEN length(s) > 42 THEN rtrim(substr(s, 1, 41), ' ') || '…' ELSE s END AS t FROM (SELECT *, trim(string_split_regex(string_split(text, chr(10))[1], '[。；;！？!?]')[1], ' ') AS s FROM documents))",
    "structured_rules": f"""WITH {_STD} SELECT doc_id, code AS rule_id, source || ' / ' || doc_id || '.1 ' || code || ' ' || title AS section, 2 AS line_start, 11 AS line_end, CASE WHEN doc_id % 2 = 0 THEN 'advisory' WHEN {_REQ} THEN 'major' ELSE 'advisory' END AS severity, 0.96e0 AS confidence, title, 'D' || chr(10) || '#### deeper' AS description, '# no heading ' || lang AS negative, 'ok' AS positive,
      'coding_context,ai_review' AS enforcement, 'coding,structured-rule,' || code AS tags FROM c""",
    "structured_and_prose": f"""WITH {_STD}, u AS (SELECT document, 'structured' AS kind, CASE WHEN doc_id % 2 = 0 THEN 'advisory' WHEN {_REQ} THEN 'major' ELSE 'advisory' END AS severity, 2 AS line FROM c UNION ALL SELECT document, 'prose', 'major', 13 FROM c)
      SELECT document, kind, severity, count(*) AS n, sum(line)::bigint AS lines FROM u GROUP BY document, kind, severity""",
    "qualified_ids": """WITH r AS (SELECT doc_id, 'G.' || upper(lang) || '.' || (doc_id % 97) AS id, 'std/' || source || '.md' AS document, source AS space, lang, doc_id AS line, substr(text, 1, 20) AS statement FROM documents),
      g AS (SELECT *, count(*) OVER (PARTITION BY lower(id)) AS n, count(*) OVER (PARTITION BY lower(id), lower(space)) AS m, row_number() OVER (PARTITION BY lower(id), lower(document) ORDER BY line, lower(statement)) AS k FROM r)
      SELECT doc_id, CASE WHEN n = 1 THEN id WHEN m = 1 THEN space || '::' || id WHEN k = 1 THEN space || '-' || substr(sha256(lower(document)), 1, 8) || '::' || id ELSE space || '-' || substr(sha256(document || chr(0) || lang || chr(0) || line || chr(0) || statement), 1, 10) || '::' || id END AS rule_id, CASE WHEN n > 1 THEN id END AS original_id FROM g""",
    "trigger_terms": f"""WITH t AS (SELECT doc_id, regexp_replace(text, '[^\\x00-\\x7F]', '', 'g') AS t FROM documents), l AS (SELECT doc_id, t, list_concat(regexp_extract_all(t, '`([^`\\n]{{1,100}})`', 1), regexp_extract_all(t, '@[A-Z][A-Za-z0-9_]*|\\b{_NAME}(?:\\.{_NAME})+\\b|\\b{_NAME}(?:\\.java|\\.xml|\\.yml|\\.yaml|\\.properties)\\b'), regexp_extract_all(t, '(\\b{_NAME}(?:\\.{_NAME})+)\\s*\\(', 1)) AS found FROM t)
      SELECT doc_id, coalesce(array_to_string(list_sort(list_distinct(list_filter(list_transform(found, lambda x: {_STRIP.format('x')}), lambda x: length(x) > 1 AND length(x) <= 100))), ' '), '') AS terms,
      'coding_context,' || CASE WHEN regexp_matches(t, '(?i)package|module|src/main|[/\\\\]|\\*\\*/') THEN 'path_check,' ELSE '' END || CASE WHEN regexp_matches(t, '(?i)`[^`]+`|@[A-Z][A-Za-z0-9_]*|\\b{_NAME}(?:\\.{_NAME})+\\b|\\b(?:new|catch|throw|return)\\s+{_NAME}') THEN 'static_check,' ELSE '' END || 'ai_review' AS enforcement FROM l""",
    "search_hints": "SELECT doc_id, array_to_string(list_filter(['A', 'B', 'C', 'D'], lambda h: CASE h WHEN 'A' THEN one WHEN 'B' THEN one OR two WHEN 'C' THEN two ELSE three END), ',') AS hints FROM (SELECT doc_id, contains(t, 'theth') OR contains(t, 'queel') AS one, contains(t, 'erander') AS two, contains(t, 'ofthe') AS three FROM (SELECT doc_id, replace(lower(text), ' ', '') AS t FROM documents))",
    "nfkc_fold": "SELECT doc_id, length(text) + length(text) - length(replace(text, 'ß', '')) AS n, sha256(regexp_replace(text, '\\s+', '', 'g')) AS sha FROM documents",
    "strip_markup_text": f"SELECT id, sha256(p) AS plain_sha256, length(p) AS n FROM (SELECT 'p' || page_id AS id, {_STRIP.format('html')} AS p FROM pages UNION ALL SELECT 'd' || doc_id, {_STRIP.format('text')} FROM documents)",
    "rule_id_hash": "SELECT doc_id, 'AUTO-' || substr(regexp_replace(regexp_replace(upper(source), '[^A-Z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 18) || '-' || upper(substr(sha256(trim(source, ' ') || chr(31) || lang || ' ' || source || chr(31) || trim(text, ' ')), 1, 10)) AS rule_id FROM documents",
    "id_collision_groups": "SELECT doc_id, id, n_same, place FROM (SELECT doc_id, id, count(*) OVER (PARTITION BY lower(id)) AS n_same, row_number() OVER (PARTITION BY lower(id) ORDER BY doc_id) AS place FROM (SELECT doc_id, source || '::' || substr(text, 1, 4) AS id FROM documents)) WHERE n_same > 1",
}
