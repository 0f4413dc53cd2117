"""Registered check queries: pages are files (URL path and HTML), documents texts, orders change sets."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import stored
from ..functions.text import path_matches
from ..operators import checks as c
from ..operators import specs

RULES = [
    c.Rule("NO-TRACK", "regex_forbid", (r"track\(\d+\)",), include=("**/en/*", "**/fr/*"), severity="blocker"),
    c.Rule("NO-AD", "regex_forbid", (r'class="ad"', r"<!-- ad \d+ -->"), severity="advisory", most_findings=2),
    c.Rule("HAS-TITLE", "regex_require", (r"<title>[^<]+</title>", r"<h1>"), severity="major"),
    c.Rule("ANY-LIST", "regex_require", (r"<table", r"<ol>"), require_all=False, severity="advisory", blocking=True),
    c.Rule("PATH-LANG", "path_allow", ("**/en/*", "**/de/*"), when_terms=("<article",), severity="major"),
    c.Rule("PATH-QUERY", "path_forbid", ("*[?]page=*",), exclude=("**/de/*",), severity="blocker", blocking=False),
    c.Rule("READ-TABLE", "ai_review", when_pattern=r"<h2>", triggers=("<table", "nav", "/es/"), severity="blocker"),
]


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select(F.regexp_replace("url", r"^https?://[^/]+/", "").alias("path"), F.col("html").alias("content"), "page_id")


def path_glob_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir)
    return files.select("page_id", path_matches(F.col("path"), ["**/en/*"]).alias("en"), path_matches(F.col("path"), ["*[?]page=*", "*#top"]).alias("extra"), path_matches(F.col("path"), ["fr/?[0-9]*"]).alias("fr"))


def include_exclude_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = c.Rule("SCOPE", "ai_review", include=("**/en/*", "**/de/*"), exclude=("*#top",))
    return c.applies(_files(spark, sf_dir), c.rules_frame(spark, [rule])).select("rule_id", "page_id")


def content_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = c.Rule("WHEN", "ai_review", when_pattern=r"<h1>[A-Z]", when_terms=("<TABLE", "track(1"))
    return c.applies(_files(spark, sf_dir), c.rules_frame(spark, [rule])).select("rule_id", "page_id")


def _by_page(spark: SparkSession, sf_dir: str, kinds: tuple[str, ...]) -> DataFrame:
    return c.verdicts(_files(spark, sf_dir), c.rules_frame(spark, [r for r in RULES if r.kind in kinds]), ["page_id"])


def regex_forbid_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_page(spark, sf_dir, ("regex_forbid",)).select("page_id", "rule_id", "status", "n_hits")


def regex_forbid_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir).withColumn("path", F.concat_ws(":", F.col("page_id").cast("string"), "path"))
    rules = [c.Rule("NO-AD", "regex_forbid", (r'class="ad"', r"<!-- ad \d+ -->"), most_findings=2)]
    return c.findings(files, c.rules_frame(spark, rules)).drop("check_id")


def regex_require(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_page(spark, sf_dir, ("regex_require",)).select("page_id", "rule_id", "status")


def path_allow_forbid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_page(spark, sf_dir, ("path_allow", "path_forbid")).select("page_id", "rule_id", "status")


def blocking_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _by_page(spark, sf_dir, tuple({r.kind for r in RULES}))
    return found.groupBy("rule_id", "severity", "status").agg(F.count("*").alias("n"), F.count_if("blocking").alias("n_blocking"))


def applicable_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir).withColumn("path", F.concat_ws("/", F.lit("p"), F.col("page_id").cast("string"), "path"))
    return c.applicable(files, c.rules_frame(spark, RULES), 5).drop("checkers")


def companion_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, parts = spark.read.parquet(f"{sf_dir}/lineitem.parquet"), spark.read.parquet(f"{sf_dir}/part.parquet")
    changes = items.select(F.col("l_orderkey").alias("change_id"), "l_partkey").join(parts.select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("path")), "l_partkey")
    return c.companion_changes(changes.select("change_id", "path"), ["PROMO*"], ["*MEDIUM*", "*SMALL*"], require_all=False)


#: Rule records as people write them: aliases, several checks, a bad pattern, a draft, phases, companions.
RECORDS = [
    {"id": "R-TRACK", "statement": "no tracking", "severity": "blocker", "checks": [{"type": "regex_forbid", "regex": r"(tr)ack\((\d)\2", "flags": "ignorecase", "max_findings": 2, "path_globs": ["**/en/*", "**/fr/*"]}], "source": {"document": "web.md", "section": "1"}},
    {"id": "R-BAD", "statement": "broken", "severity": "major", "metadata": {"checker": {"type": "regex_require", "pattern": "(unclosed", "when_terms": "<TABLE"}}},
    {"id": "R-EMPTY", "statement": "empty", "check": {"type": "path_allow", "include_paths": "**/de/*"}},
    {"id": "R-PATH", "statement": "paths", "severity": "advisory", "checks": {"type": "path_forbid", "forbidden_paths": ["*[?]page=*"], "blocking": True}, "metadata": {"exclude_paths": ["**/de/*"]}},
    {"id": "R-READ", "statement": "read it", "severity": "blocker", "enforcement": [{"type": "ai_review", "phases": ["stop"], "prompt": "look", "when_pattern": "<h2>"}]},
    {"id": "R-LATE", "statement": "late", "enforcement_candidates": ["ai_review"], "metadata": {"when_pattern": "<h1>"}},
    {"id": "R-DRAFT", "statement": "no", "status": "pending_review", "check": "ai_review"},
    {"id": "R-PAIR", "statement": "pairs", "severity": "blocker", "checker": {"type": "companion_change", "trigger": ["**/en/*"], "requires": ["**/de/*", "**/fr/*"], "require_all": False}},
    {"id": "R-LONE", "statement": "lone", "checker": {"type": "companion_change", "trigger": ["**/en/*"]}},
    {"id": "R-UNSAFE", "statement": "unsafe", "check": {"type": "regex_forbid", "pattern": "(a+)+"}},
    {"id": "R-TWO", "statement": "two", "severity": "major", "checks": [
        {"type": "regex_forbid", "pattern": 'class="ad"', "message": "no ad", "max_findings": 1}, {"type": "regex_forbid", "pattern": r"<!-- ad \d+ -->", "message": "no note", "severity": "blocker", "max_findings": 1},
        {"type": "regex_require", "pattern": "<h1>", "message": "head"}, {"type": "regex_require", "pattern": "<ol>", "message": "list", "severity": "blocker"},
        {"type": "path_forbid", "paths": ["*#top"], "message": "top"}, {"type": "path_forbid", "paths": ["**/de/*"], "message": "german", "blocking": True},
        {"type": "path_allow", "paths": ["**/fr/*"], "message": "french"}, {"type": "path_allow", "paths": ["**/en/*", "**/[!e]?/*"], "message": "english"},
        {"type": "ai_review", "when_pattern": "<h2>", "prompt": "once"}, {"type": "ai_review", "when_pattern": "<h2>", "prompt": "twice"},
        {"type": "companion_change", "trigger": ["**/en/*"], "requires": ["**/de/*", "*.none"], "message": "pair one"}, {"type": "companion_change", "trigger": ["**/fr/*"], "requires": ["*.none", "**/de/*"], "require_all": False, "message": "pair two", "severity": "blocker"},
    ]},
]


def _rules(spark: SparkSession) -> DataFrame:
    return stored(specs.rules_table(spark.createDataFrame([(json.dumps(r),) for r in RECORDS], "record string")), "rules")


def check_file_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All results of all pages as files, each check by itself, error rows and reviews of the phase included."""
    found = c.check_files(_files(spark, sf_dir), _rules(spark), "post", keep=["page_id"])
    return found.select("page_id", "check_id", "rule_id", "kind", "status", "severity", "blocking", F.when(F.col("status") == "error", "").otherwise(F.col("message")).alias("message"), "line", "evidence", "source")


def change_set_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change sets of pages (by number modulo 40): file checks at the end of a task, and companion checks."""
    files = _files(spark, sf_dir).select((F.col("page_id") % 40).alias("change_id"), "path", "content")
    found = c.check_change_sets(files, _rules(spark), fail_closed=False)
    return found.groupBy("change_id", "check_id", "rule_id", "kind", "status", "blocking").agg(F.count("*").alias("n"), F.max("evidence").alias("evidence"), F.max(F.when(F.col("kind") == "companion_change", F.regexp_replace("message", "^invalid.*", ""))).alias("message"))


def _part_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as rule records: by its type a part declares a check, names candidates, is disabled, or says nothing."""
    kind = F.col("p_type")
    check = F.when(kind.startswith("PROMO"), F.struct(F.lit("regex_forbid").alias("type"), F.col("p_name").alias("pattern"))).when(kind.startswith("ECONOMY"), F.struct(F.lit("ai_review").alias("type"), F.lit(None).cast("string").alias("pattern")))
    meta = F.struct(F.when(kind.startswith("MEDIUM"), F.lit(True)).alias("enforcement_disabled"), F.when(kind.startswith("SMALL"), F.array(F.lit("odd"), F.lit("Path_Allow"))).alias("enforcement_candidates"))
    rows = spark.read.parquet(f"{sf_dir}/part.parquet")
    return rows.select(F.to_json(F.struct(F.concat_ws("-", "p_brand", F.col("p_partkey").cast("string")).alias("id"), check.alias("check"), meta.alias("metadata"))).alias("record"))


def configured_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of each brand's parts, as rule records, have a check besides a review."""
    found = specs.configured(_part_records(spark, sf_dir))
    return found.groupBy(F.regexp_extract("rule_id", "^(.*)-[0-9]+$", 1).alias("brand")).agg(F.count("*").alias("rules"), F.count_if("configured").alias("configured"))


def draft_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as drafts of two checks, of a kind and with a pattern that follow their numbers: everything that is wrong with them."""
    k = F.col("doc_id")
    kind = F.get(F.array(*map(F.lit, ("regex_forbid", "path_allow", "bogus", "companion_change", "REGEX_REQUIRE"))), (k % 5).cast("int"))
    first = F.struct(kind.alias("type"), F.when(k % 3 == 0, F.concat(F.lit("("), "text")).when(k % 3 == 1, F.lit("(a+)+")).alias("pattern"))
    second = F.struct(F.when(k % 2 == 0, "regex_require").alias("checker"), F.when(k % 7 > 0, "lang").alias("regex"), F.when(k % 11 == 0, "[").alias("when_pattern"))
    records = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.to_json(first).alias("a"), F.to_json(second).alias("b"), k)
    record = F.concat(F.lit('{"id": "D'), k.cast("string"), F.lit('", "checks": ['), F.when(k % 13 > 0, F.concat("a", F.lit(", "), "b")).otherwise(""), F.lit("]}"))
    return specs.draft_errors(records.select(record.alias("record")))


QUERIES = {f.__name__: f for f in (path_glob_match, include_exclude_scope, content_trigger, regex_forbid_count, regex_forbid_findings, regex_require, path_allow_forbid, blocking_decision, applicable_score, companion_change, check_file_results, change_set_results, configured_checks, draft_problems)}

_F = "f AS (SELECT page_id, regexp_replace(url, '^https?://[^/]+/', '') AS path, html FROM pages)"
_N = "g AS (SELECT *, lower(path) AS p, string_split(lower(path), '/')[-1] AS b FROM f)"
_EN, _DE, _FR = ("(regexp_matches(p, '(?s)^(.*/)?{0}/.*$') OR regexp_matches(b, '(?s)^(.*/)?{0}/.*$'))".format(x) for x in ("en", "de", "fr"))
_PAGE = "(regexp_matches(p, '(?s)^.*[?]page=.*$') OR regexp_matches(b, '(?s)^.*[?]page=.*$'))"
_TOP = "(regexp_matches(p, '(?s)^.*#top$') OR regexp_matches(b, '(?s)^.*#top$'))"
_V = f"""v AS (
  SELECT page_id, 'NO-TRACK' AS rule_id, 'blocker' AS severity, CASE WHEN n = 0 THEN 'pass' ELSE 'fail' END AS status, least(n, 3) AS n_hits, 'regex_forbid' AS kind, n > 0 AS blocking FROM (SELECT *, len(regexp_extract_all(html, 'track\\(\\d+\\)')) AS n FROM g WHERE {_EN} OR {_FR})
  UNION ALL SELECT page_id, 'NO-AD', 'advisory', CASE WHEN n = 0 THEN 'pass' ELSE 'fail' END, least(n, 2), 'regex_forbid', false FROM (SELECT *, len(regexp_extract_all(html, 'class="ad"')) + len(regexp_extract_all(html, '<!-- ad \\d+ -->')) AS n FROM g)
  UNION ALL SELECT page_id, 'HAS-TITLE', 'major', CASE WHEN ok THEN 'pass' ELSE 'fail' END, 0, 'regex_require', NOT ok FROM (SELECT *, regexp_matches(html, '<title>[^<]+</title>') AND regexp_matches(html, '<h1>') AS ok FROM g)
  UNION ALL SELECT page_id, 'ANY-LIST', 'advisory', CASE WHEN ok THEN 'pass' ELSE 'fail' END, 0, 'regex_require', NOT ok FROM (SELECT *, regexp_matches(html, '<table') OR regexp_matches(html, '<ol>') AS ok FROM g)
  UNION ALL SELECT page_id, 'PATH-LANG', 'major', CASE WHEN ok THEN 'pass' ELSE 'fail' END, 0, 'path_allow', NOT ok FROM (SELECT *, {_EN} OR {_DE} AS ok FROM g WHERE contains(lower(html), '<article'))
  UNION ALL SELECT page_id, 'PATH-QUERY', 'blocker', CASE WHEN ok THEN 'pass' ELSE 'fail' END, 0, 'path_forbid', false FROM (SELECT *, NOT {_PAGE} AS ok FROM g WHERE NOT {_DE})
  UNION ALL SELECT page_id, 'READ-TABLE', 'blocker', 'review', 0, 'ai_review', false FROM g WHERE regexp_matches(html, '<h2>'))"""
_G = f"WITH {_F}, {_N}"
_SCORES = f"""s AS (
  SELECT p2 AS path, 'NO-TRACK' AS rule_id, 1 + 3 + 2 AS score FROM h WHERE {_EN} OR {_FR}
  UNION ALL SELECT p2, 'NO-AD', 1 FROM h UNION ALL SELECT p2, 'HAS-TITLE', 1 FROM h UNION ALL SELECT p2, 'ANY-LIST', 1 FROM h
  UNION ALL SELECT p2, 'PATH-LANG', 1 + 3 FROM h WHERE contains(lower(html), '<article')
  UNION ALL SELECT p2, 'PATH-QUERY', 1 + 2 FROM h WHERE NOT {_DE}
  UNION ALL SELECT p2, 'READ-TABLE', 1 + 4 * len(list_filter(['<table', 'nav', '/es/'], lambda t: contains(p || chr(10) || lower(html), t))) + 3 + 2 FROM h WHERE regexp_matches(html, '<h2>'))"""
_MATCHES = " UNION ALL ".join(f"SELECT page_id || ':' || path AS path, {k} AS k, regexp_extract_all(html, '{p}') AS found, string_split_regex(html, '{p}') AS parts FROM f" for k, p in enumerate(('class="ad"', "<!-- ad \\d+ -->")))
_TRACK = "(?i)track\\((?:00|11|22|33|44|55|66|77|88|99)"
_BEFORE = f"array_to_string(parts[1:i + 1], '') || array_to_string(found[1:i], '')"
_AD, _NOTE = ("string_split_regex(html, '{0}')[1]".format(p) for p in ('class="ad"', "<!-- ad \\d+ -->"))


def _own(no: int, kind: str, severity: str, ok: str, blocks: bool, message: str, line: str = "0", evidence: str = "''") -> str:
    """A check of R-TWO over all pages."""
    return f"UNION ALL SELECT page_id, path, 'R-TWO#{no}', '{kind}', CASE WHEN {ok} THEN 'pass' ELSE 'fail' END, '{severity}', {str(blocks).lower()} AND NOT ({ok}), CASE WHEN {ok} THEN '' ELSE '{message}' END, CASE WHEN {ok} THEN 0 ELSE {line} END, CASE WHEN {ok} THEN '' ELSE {evidence} END, '' FROM g"


_LINE = lambda before: f"1 + length({before}) - length(replace({before}, chr(10), ''))"
_TWO = "\n  ".join([
    _own(1, "regex_forbid", "major", "NOT contains(html, 'class=\"ad\"')", False, "no ad", _LINE(_AD), "'class=\"ad\"'"), _own(2, "regex_forbid", "blocker", "NOT regexp_matches(html, '<!-- ad \\d+ -->')", True, "no note", _LINE(_NOTE), "regexp_extract(html, '<!-- ad \\d+ -->')"),
    _own(3, "regex_require", "major", "contains(html, '<h1>')", False, "head"), _own(4, "regex_require", "blocker", "contains(html, '<ol>')", True, "list"), _own(5, "path_forbid", "major", f"NOT {_TOP}", False, "top"), _own(6, "path_forbid", "major", f"NOT {_DE}", True, "german"),
    _own(7, "path_allow", "major", _FR, False, "french"), _own(8, "path_allow", "major", f"({_EN} OR regexp_matches(p, '(?s)^(.*/)?[^e]./.*$') OR regexp_matches(b, '(?s)^(.*/)?[^e]./.*$'))", False, "english"),
    *[f"UNION ALL SELECT page_id, path, 'R-TWO#{no}', 'ai_review', 'review', 'major', false, '{said}', 0, '', '' FROM g WHERE regexp_matches(html, '<h2>')" for no, said in ((9, "once"), (10, "twice"))],
])
_FILES = f"""t AS (SELECT page_id, path, regexp_extract_all(html, '{_TRACK}')[1:2] AS found, string_split_regex(html, '{_TRACK}') AS parts FROM g WHERE {_EN} OR {_FR}), te AS (SELECT *, unnest(range(len(found))) AS i FROM t),
  r AS (SELECT page_id, path, 'R-TRACK' AS rule_id, 'regex_forbid' AS kind, 'fail' AS status, 'blocker' AS severity, true AS blocking, 'no tracking' AS message, 1 + length({_BEFORE}) - length(replace({_BEFORE}, chr(10), '')) AS line, found[i + 1] AS evidence, 'web.md / 1' AS source FROM te
  UNION ALL SELECT page_id, path, 'R-TRACK', 'regex_forbid', 'pass', 'blocker', false, '', 0, '', 'web.md / 1' FROM t WHERE len(found) = 0
  UNION ALL SELECT page_id, path, 'R-BAD', 'regex_require', 'error', 'major', true, '', 0, '', '' FROM g WHERE contains(lower(html), '<table')
  UNION ALL SELECT page_id, path, 'R-EMPTY', 'path_allow', 'error', 'major', true, '', 0, '', '' FROM g WHERE {_DE}
  UNION ALL SELECT page_id, path, 'R-PATH', 'path_forbid', CASE WHEN {_PAGE} THEN 'fail' ELSE 'pass' END, 'advisory', {_PAGE}, CASE WHEN {_PAGE} THEN 'paths' ELSE '' END, 0, '', '' FROM g WHERE NOT {_DE}
  UNION ALL SELECT page_id, path, 'R-LATE', 'ai_review', 'review', 'major', false, 'late', 0, '', '' FROM g WHERE regexp_matches(html, '<h1>')
  UNION ALL SELECT page_id, path, 'R-READ', 'ai_review', 'review', 'blocker', false, 'look', 0, '', '' FROM g WHERE regexp_matches(html, '<h2>')
  UNION ALL SELECT page_id, path, 'R-UNSAFE', 'regex_forbid', 'error', 'major', true, '', 0, '', '' FROM g
  {_TWO})"""
ORACLES = {
    "check_file_results": f"{_G}, {_FILES} SELECT page_id, CASE WHEN contains(rule_id, '#') THEN rule_id ELSE rule_id || '#1' END AS check_id, string_split(rule_id, '#')[1] AS rule_id, kind, status, severity, blocking, message, line, evidence, source FROM r WHERE rule_id <> 'R-READ'",
    "change_set_results": f"""{_G.replace('SELECT page_id,', 'SELECT page_id, page_id % 40 AS change_id,')}, {_FILES},
      f2 AS (SELECT page_id % 40 AS change_id, rule_id, kind, status, blocking AND status <> 'error' AS blocking, evidence, NULL AS message FROM r),
      cs AS (SELECT DISTINCT change_id, path, {_EN} AS en, {_DE} AS de, {_FR} AS fr FROM g),
      cc AS (SELECT change_id, array_to_string(list_sort(list(path) FILTER (en))[1:5], ', ') AS evidence, array_to_string(list_sort(list(path) FILTER (fr))[1:5], ', ') AS french, bool_or(en) AS en, bool_or(de) AS de, bool_or(fr) AS fr FROM cs GROUP BY change_id),
      u AS (SELECT * FROM f2 UNION ALL SELECT change_id, 'R-PAIR', 'companion_change', CASE WHEN de OR fr THEN 'pass' ELSE 'fail' END, NOT (de OR fr), evidence, CASE WHEN de OR fr THEN '' ELSE 'pairs；缺少：**/de/*, **/fr/*' END FROM cc WHERE en
        UNION ALL SELECT change_id, 'R-TWO#11', 'companion_change', 'fail', false, evidence, 'pair one；缺少：' || CASE WHEN de THEN '' ELSE '**/de/*, ' END || '*.none' FROM cc WHERE en
        UNION ALL SELECT change_id, 'R-TWO#12', 'companion_change', CASE WHEN de THEN 'pass' ELSE 'fail' END, NOT de, french, CASE WHEN de THEN '' ELSE 'pair two；缺少：*.none, **/de/*' END FROM cc WHERE fr
        UNION ALL SELECT DISTINCT change_id, 'R-LONE', 'companion_change', 'error', false, '', '' FROM cs)
      SELECT change_id, CASE WHEN contains(rule_id, '#') THEN rule_id ELSE rule_id || '#1' END AS check_id, string_split(rule_id, '#')[1] AS rule_id, kind, status, blocking, count(*) AS n, max(evidence) AS evidence, max(message) AS message FROM u GROUP BY ALL""",
    "configured_checks": "SELECT p_brand AS brand, count(*) AS rules, count(*) FILTER (starts_with(p_type, 'PROMO') OR starts_with(p_type, 'SMALL')) AS configured FROM part GROUP BY p_brand",
    "draft_problems": """WITH d AS (SELECT 'D' || doc_id AS rule_id, doc_id AS k, ['regex_forbid', 'path_allow', 'bogus', 'companion_change', 'regex_require'][doc_id % 5 + 1] AS kind FROM documents),
      p AS (SELECT rule_id, 0 AS check_no, 'no check declared' AS problem FROM d WHERE k % 13 = 0
        UNION ALL SELECT rule_id, 1, CASE WHEN kind = 'bogus' THEN 'unknown type bogus' WHEN kind LIKE 'regex%' AND k % 3 < 2 THEN CASE WHEN k % 3 = 1 THEN 'nested repetition' WHEN length(text) + 1 > 2000 THEN 'pattern longer than 2000 characters' ELSE 'invalid pattern' END ELSE kind || ' lacks its patterns' END FROM d JOIN documents ON doc_id = k WHERE k % 13 > 0
        UNION ALL SELECT rule_id, 2, 'unknown type (none)' FROM d WHERE k % 13 > 0 AND k % 2 = 1 UNION ALL SELECT rule_id, 2, 'regex_require lacks its patterns' FROM d WHERE k % 13 > 0 AND k % 2 = 0 AND k % 7 = 0 UNION ALL SELECT rule_id, 2, 'invalid pattern' FROM d WHERE k % 13 > 0 AND k % 2 = 0 AND k % 11 = 0)
      SELECT * FROM p""",
    "path_glob_match": f"{_G} SELECT page_id, {_EN} AS en, {_PAGE} OR {_TOP} AS extra, regexp_matches(p, '(?s)^fr/.[0-9].*$') OR regexp_matches(b, '(?s)^fr/.[0-9].*$') AS fr FROM g",
    "include_exclude_scope": f"{_G} SELECT 'SCOPE' AS rule_id, page_id FROM g WHERE ({_EN} OR {_DE}) AND NOT {_TOP}",
    "content_trigger": f"{_G} SELECT 'WHEN' AS rule_id, page_id FROM g WHERE regexp_matches(html, '<h1>[A-Z]') AND (contains(lower(html), '<table') OR contains(lower(html), 'track(1'))",
    "regex_forbid_count": f"{_G}, {_V} SELECT page_id, rule_id, status, n_hits FROM v WHERE kind = 'regex_forbid'",
    "regex_forbid_findings": f"""WITH {_F}, m AS ({_MATCHES}), e AS (SELECT *, unnest(range(least(len(found), 2))) AS i FROM m),
      l AS (SELECT *, array_to_string(parts[1:i + 1], '') || array_to_string(found[1:i], '') AS before FROM e)
      SELECT * FROM (SELECT 'NO-AD' AS rule_id, path, row_number() OVER (PARTITION BY path ORDER BY k, i) - 1 AS n, 1 + length(before) - length(replace(before, chr(10), '')) AS line, trim(regexp_replace(found[i + 1], '\\s+', ' ', 'g'), ' ') AS evidence FROM l) WHERE n < 2""",
    "regex_require": f"{_G}, {_V} SELECT page_id, rule_id, status FROM v WHERE kind = 'regex_require'",
    "path_allow_forbid": f"{_G}, {_V} SELECT page_id, rule_id, status FROM v WHERE kind IN ('path_allow', 'path_forbid')",
    "blocking_decision": f"{_G}, {_V} SELECT rule_id, severity, status, count(*) AS n, count(*) FILTER (blocking) AS n_blocking FROM v GROUP BY rule_id, severity, status",
    "applicable_score": f"WITH {_F}, h AS (SELECT *, 'p/' || page_id || '/' || path AS p2, lower('p/' || page_id || '/' || path) AS p, string_split(lower(path), '/')[-1] AS b FROM f), {_SCORES} SELECT path, rule_id, score::bigint AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY score DESC, rule_id) AS rank FROM s) WHERE rank <= 5",
    "companion_change": """SELECT change_id, n_paths, CASE WHEN met THEN 'pass' ELSE 'fail' END AS status FROM (
      SELECT l_orderkey AS change_id, count(DISTINCT p_type) AS n_paths, bool_or(starts_with(lower(p_type), 'promo')) AS fired, bool_or(contains(lower(p_type), 'medium') OR contains(lower(p_type), 'small')) AS met
      FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey) WHERE fired""",
}
