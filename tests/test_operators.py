"""Operators of the library proper on inline fixtures."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

from normlake.functions.edits import apply_edits
from normlake.functions.sizes import broadcast_if_small
from normlake.functions import lexicon as lx
from normlake.functions import payloads
from normlake.functions.text import ascii_bounds, folded, glob_regex, normalised, path_matches, plain_text, postings, strip_markup
from normlake.functions.text import title as title_of
from normlake.operators import audit, bundles, checks, extraction, gates, retrieval, review, specs
from normlake.sources import markdown, records


def test_token_traps(spark):
    docs = spark.createDataFrame([(1, "getUserName foo foo XMLFoo a.b-c 1.2"), (2, "线程池管理 字 Map.of"), (3, None), (4, "")], "doc_id long, text string")
    found = {(r["doc_id"], r["token"]): r["tf"] for r in postings(docs, "doc_id", "text").collect()}
    assert found[1, "foo"] == 4 and found[1, "getusername"] == 1 and found[1, "user"] == 1 and (1, "xml") not in found
    assert found[1, "a.b-c"] == 1 and found[1, "a"] == 1 and found[1, "1.2"] == 1
    assert found[2, "线程池管理"] == 1 and found[2, "线程"] == 1 and found[2, "线程池"] == 1 and found[2, "字"] == 2 and found[2, "map.of"] == 1 and found[2, "of"] == 1
    assert not {k for k in found if k[0] > 2}


def test_ranking_of_the_map_rules(spark):
    rules = spark.createDataFrame([("MAP-NULL", "Map.of 不允许 null 集合"), ("MAP-COPY", "Map.copyOf 集合 拷贝"), ("THREAD-POOL", "线程池 管理")], "doc_id string, text string")
    queries = spark.createDataFrame([(1, "Map.of 集合", "src/main/java/Foo.java", 'return Map.of("key", value);')], "query_id long, q string, p string, c string")
    terms = retrieval.query_terms(queries, {"query": "q", "path": "p", "code": "c"}, ["src", "main", "java", "value"])
    weights = {r["token"]: r["w"] for r in terms.collect()}
    assert weights["map.of"] == 4.0 and weights["集合"] == 3.0 and weights["foo"] == 2.0 and "java" not in weights
    ranked = retrieval.top_k(retrieval.bm25(retrieval.build_index(rules), terms), 10).orderBy("rank").collect()
    assert [r["doc_id"] for r in ranked][0] == "MAP-NULL" and "THREAD-POOL" not in {r["doc_id"] for r in ranked}


def test_floor_ties_and_direct_results(spark):
    scored = spark.createDataFrame([(1, 1, 10.0), (1, 2, 2.1), (1, 3, 2.2), (1, 4, 10.0)], "query_id long, doc_id long, score double")
    assert [r["doc_id"] for r in retrieval.top_k(scored, 9).orderBy("rank").collect()] == [1, 4, 3]
    direct = scored.where("doc_id in (2, 3)")
    found = retrieval.direct_first(direct, scored, 1).orderBy("place").collect()
    assert [(r["doc_id"], r["origin"]) for r in found] == [(3, "direct"), (2, "direct")]
    assert retrieval.direct_first(direct, scored, 0).count() == 0


def test_cosine_of_odd_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0], [1.0, 0.0]), (2, [1.0], [1.0, 0.0]), (3, [], []), (4, [0.0, 0.0], [1.0, 0.0])], "i int, a array<double>, b array<double>")
    assert [r[0] for r in rows.orderBy("i").select(retrieval.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, -1.0, -1.0, -1.0]


def test_hybrid_admits_semantic_only_results(spark):
    lexical = spark.createDataFrame([(1, "NAME-RULE", 0.5)], "query_id long, doc_id string, score double")
    similar = spark.createDataFrame([(1, "FORMAT-RULE", 0.99)], "query_id long, doc_id string, sim double")
    best = retrieval.blend(lexical, similar, 0.8).orderBy(F.desc("score")).first()
    assert best["doc_id"] == "FORMAT-RULE" and abs(best["score"] - 0.8 * 8 * 0.99) < 1e-9


@pytest.mark.parametrize("glob,path,want", [("*.java", "a/b/C.java", True), ("**/web/**", "src/web/x", True), ("**/x", "x", True), ("**/x", "a/b/x", True), ("src/*/y", "src/a/b/y", True), ("[!a]b", "cb", True), ("[!a]b", "ab", False), ("A?.md", "a1.MD", True), ("a.b", "axb", False), ("./a//b", "a/b", True)])
def test_globs(spark, glob, path, want):
    assert spark.range(1).select(path_matches(F.lit(path), [glob])).first()[0] is want and glob_regex(glob).startswith("(?s)^")


def test_checks(spark):
    files = spark.createDataFrame([("src/main/java/internal/FooController.java", "@RestController\nclass A { void f() { new Thread(task).start(); new  Thread(b); } }"), ("README.md", None)], "path string, content string")
    rules = [
        checks.Rule("THREAD", "regex_forbid", (r"\bnew\s+Thread\s*\(",)), checks.Rule("WEB", "path_allow", ("**/web/**",), when_pattern="@RestController"), checks.Rule("NEED", "regex_require", ("class", "interface"), include=("*.java",)),
        checks.Rule("ANY", "regex_require", ("class", "interface"), include=("*.java",), require_all=False, severity="advisory"), checks.Rule("EYES", "ai_review", severity="blocker", exclude=("*.md",)),
    ]
    frame = checks.rules_frame(spark, rules)
    found = {(r["rule_id"], r["path"][-4:]): (r["status"], r["blocking"]) for r in checks.verdicts(files, frame).collect()}
    assert found == {("THREAD", "java"): ("fail", True), ("THREAD", "E.md"): ("pass", False), ("WEB", "java"): ("fail", True), ("NEED", "java"): ("fail", True), ("ANY", "java"): ("pass", False), ("EYES", "java"): ("review", False)}
    lines = [(r["n"], r["line"], r["evidence"]) for r in checks.findings(files, frame).orderBy("n").collect()]
    assert lines == [(0, 2, "new Thread("), (1, 2, "new Thread(")]
    shown = {r["rule_id"]: r["score"] for r in checks.applicable(files.where("path like '%java'"), frame).collect()}
    assert shown == {"THREAD": 1, "WEB": 4, "NEED": 4, "ANY": 4}


def test_invalid_patterns_flags_and_references(spark):
    files = spark.createDataFrame([("a.txt", "xaab\nBB cc"), ("b.txt", "none")], "path string, content string")
    records = [
        {"id": "BROKEN", "check": {"type": "regex_forbid", "pattern": "("}}, {"id": "WHEN", "check": {"type": "regex_require", "pattern": "x", "when_pattern": "["}},
        {"id": "TWICE", "checks": [{"type": "regex_forbid", "pattern": r"([a-z])\1", "flags": "ignorecase"}, {"type": "regex_forbid", "pattern": "(?P<one>b)(?P=one)", "flags": ["i"]}]},
        {"id": "EYES", "statement": "look", "severity": "blocker"}, {"id": "LATER", "check": {"type": "ai_review", "phases": "stop"}}, {"id": "OFF", "metadata": {"enforcement_disabled": True}}, {"id": "OPEN", "status": "pending_review"},
    ]
    rules = specs.rules_table(spark.createDataFrame([(json.dumps(r),) for r in records], "record string"))
    found = checks.check_files(files, rules).collect()
    rows = {(r["rule_id"], r["path"][0], r["line"], r["evidence"]): (r["status"], r["blocking"]) for r in found}
    assert rows["BROKEN", "a", 0, ""] == rows["WHEN", "b", 0, ""] == ("error", True)
    assert {k[2:] for k in rows if k[:2] == ("TWICE", "a")} >= {(1, "aa"), (2, "BB"), (2, "cc")} and rows["TWICE", "b", 1, "nn"] == ("fail", False) if ("TWICE", "b", 1, "nn") in rows else rows["TWICE", "b", 0, ""] == ("pass", False)
    assert rows["EYES", "a", 0, ""] == ("review", False) and not {k for k in rows if k[0] in ("LATER", "OFF", "OPEN")}
    assert {r["rule_id"] for r in checks.check_files(files, rules, "stop", False, []).collect() if r["status"] == "review"} == set()
    assert {r["rule_id"] for r in checks.check_files(files, rules, "stop", False, ["LATER"]).collect() if r["status"] == "review"} == {"LATER"}
    assert not any(r["blocking"] for r in checks.check_files(files, rules, fail_closed=False).collect() if r["status"] == "error")


def test_companion_changes(spark):
    changes = spark.createDataFrame([(1, "a/UserMapper.java"), (2, "a/UserMapper.java"), (2, "r/UserMapper.xml"), (3, "x.txt")], "change_id long, path string")
    found = {r["change_id"]: r["status"] for r in checks.companion_changes(changes, ["**/*Mapper.java"], ["**/*Mapper.xml"]).collect()}
    assert found == {1: "fail", 2: "pass"}


def test_event_folds(spark):
    results = spark.createDataFrame([("R1", "fail", 1), ("R1", "pass", 2), ("R2", "fail", 3), ("R3", "pass", 4)], "rule_id string, status string, seq long")
    assert {r["rule_id"]: r["state"] for r in audit.issues(results, ["rule_id"], ["seq"]).collect()} == {"R1": "resolved", "R2": "unresolved"}
    reviews = spark.createDataFrame([("AI1", "p", 1), ("AI2", "p", 1), ("AI2", "p", 9)], "rule_id string, path string, seq long")
    attested = spark.createDataFrame([("AI1", 2), ("AI2", 5)], "rule_id string, seq long")
    assert [r["rule_id"] for r in audit.pending_reviews(reviews, attested).collect()] == ["AI2"]


def test_evidence_is_by_line(spark):
    messages = spark.createDataFrame([(1, "R1：审查未通过，存在严重问题。\nR2：AI 语义审查通过。")], "message_id long, text string")
    rules = spark.createDataFrame([("R1",), ("R2",)], "rule_id string")
    found = audit.evidence(messages, rules, r"审查通过|已修复|\bpass(?:ed)?\b", r"未通过|不通过|存在(?:严重)?问题")
    assert {r["rule_id"]: r["valid"] for r in found.collect()} == {"R1": False, "R2": True}


def test_evidence_has_the_word_bounds_of_sql(spark):
    rows = [(1, "x laévio"), (2, "x été la"), (3, "x la_"), (4, "x la et"), (5, "x la ét"), (6, "x étéla"), (7, "x d'étéet la"), (8, "xla")]
    found = audit.evidence(spark.createDataFrame(rows, "message_id long, text string"), spark.createDataFrame([("x",)], "rule_id string"), r"\b(the|la|der)\b", r"\b(and|et|und)\b")
    duck = duckdb.connect()
    said = lambda line, pattern: duck.execute("SELECT regexp_matches(?, ?)", [line, pattern]).fetchone()[0]
    assert {r["message_id"]: r["valid"] for r in found.collect()} == {i: said(t, r"(?i)\b(the|la|der)\b") and not said(t, r"(?i)\b(and|et|und)\b") for i, t in rows}
    assert [ascii_bounds(p) for p in ("\\\\b", r"\d")] == ["\\\\b", r"\d"]


def test_receipt_validity(spark):
    rows = spark.createDataFrame([("ready", 0.0, True), ("ready", 101.0, True), ("denied", 0.0, True), ("ready", -1.0, True), ("authorized", 5.0, False), (None, 5.0, True)], "s string, age double, same boolean")
    valid = audit.receipt_valid(F.col("s"), F.lit(1000.0) - F.col("age"), F.lit(1000.0), 100, F.col("same"))
    assert [r[0] for r in rows.select(valid).collect()] == [True, False, False, False, False, False]


def test_reconcile_and_apply(spark):
    old = spark.createDataFrame([("A", "h1"), ("B", "h2"), ("C", "h3")], "rule_id string, hash string")
    new = spark.createDataFrame([("A", "h1"), ("B", "changed")], "rule_id string, hash string")
    decisions = spark.createDataFrame([("A", "approved", "h1", None, None), ("B", "approved", "h2", None, None), ("C", "pending_review", "h3", None, ""), ("D", "pending_review", "h4", "edit", None)], "rule_id string, decision string, review_hash string, edited string, notes string")
    assert {r["rule_id"]: r["outcome"] for r in review.reconcile(old, decisions, new).collect()} == {"A": "preserved", "B": "dropped", "D": "dropped"}
    rules = new.withColumn("statement", F.lit("s"))
    assert {r["rule_id"]: r["status"] for r in review.apply(rules, decisions).collect()} == {"A": "approved", "B": "stale_hash", "C": "unknown_rule", "D": "unknown_rule"}


def test_bundle_id_ignores_order_and_follows_content(spark):
    rows = [(f"R{i}", f"h{i}") for i in range(50)]
    ids = [review.bundle_id(spark.createDataFrame(r, "rule_id string, hash string")).first()["bundle_id"] for r in (rows, rows[::-1], [*rows[1:], ("R0", "other")])]
    assert ids[0] == ids[1] != ids[2] and len(ids[0]) == 64


def test_cache_generates_nothing_twice(spark):
    keyed = spark.createDataFrame([("a",), ("b",)], "key string")
    assert review.cache_misses(keyed, keyed.limit(0)).where("cached").count() == 0
    assert review.cache_misses(keyed, keyed.union(keyed)).where("cached").count() == 2


PROSE = "---\nx: y\n---\n# Top\n## Threads\n- must use pools\n  always\n- never `new Thread`\n\n```\nmust not count\n```\n\nYou shall close\nresources.\n\n### Background\nJust words here.\n| a | must row |\n| --- | --- |\n"


def test_blocks():
    found = [(k, s, a, b) for k, s, a, b, _ in extraction.document_blocks(PROSE)]
    assert found == [("heading", "", 4, 4), ("heading", "Top", 5, 5), ("item", "Top / Threads", 6, 7), ("item", "Top / Threads", 8, 8), ("text", "Top / Threads", 14, 15), ("heading", "Top / Threads", 17, 17), ("text", "Top / Threads / Background", 18, 18), ("row", "Top / Threads / Background", 19, 19)]
    assert extraction.document_blocks("") == []


def test_extraction(spark):
    lexicon = extraction.Lexicon(r"must|shall|never", r"never|must\s+not", r"must|shall", "should", categories={"security": ("password",), "threads": ("pool", "thread")})
    docs = spark.createDataFrame([(1, PROSE + "\nYou SHALL close resources.\n", "guide.md"), (2, None, "empty.md")], "doc_id long, text string, source string")
    found = {r["statement"]: r for r in extraction.extract(docs, lexicon).collect()}
    assert set(found) == {"must use pools always", "never new Thread", "You shall close resources.", "a；must row"}
    assert found["never new Thread"]["severity"] == "blocker" and found["never new Thread"]["category"] == "threads"
    assert found["must use pools always"]["confidence"] == 0.8 and found["never new Thread"]["confidence"] == 0.88
    assert all(r["status"] == "pending_review" and r["rule_id"].startswith("AUTO-") for r in found.values())


STANDARD = """# Std
### 1.1 G.NAM.01 Names `x`
text before a field
【级别】要求
**【描述】** Use `List<String>` when a < b and c > d
#### deeper
```java
# not a heading
```
【反例】
bad | row
### 1.2 G.NAM.01 Twice
【级别】 建议
## 2 Other
- 必须 close everything here
### G.X.02 No number
"""


def test_structured_rules(spark):
    found = extraction.rule_blocks(STANDARD)
    assert [(r[1], r[2], r[4], r[5], r[6], r[7]) for r in found] == [(2, 11, "G.NAM.01", "1.1", "Names x", "要求"), (12, 13, "G.NAM.01", "1.2", "Twice", "建议"), (16, 17, "G.X.02", "", "No number", "")]
    assert found[0][8:] == ("text before a field\nUse List<String> when a < b and c > d\n#### deeper\n# not a heading", "bad；row", "") and found[0][0] == "Std" and found[2][0] == "Std / 2 Other"
    docs = spark.createDataFrame([(1, STANDARD, "std/安全 规范.md"), (2, STANDARD, "std/b.md"), (3, None, "c.md")], "doc_id long, text string, source string")
    rules = extraction.extract(docs).where("doc_id = 1").collect()
    by = {(r["line_start"], r["statement"]): r for r in rules}
    assert set(by) == {(2, "Names x"), (12, "Twice"), (15, "必须 close everything here"), (16, "No number")}
    assert by[2, "Names x"]["rule_id"] == "G.NAM.01" and by[12, "Twice"]["rule_id"].startswith("G-NAM-01-") and by[12, "Twice"]["severity"] == "advisory"
    assert by[2, "Names x"]["confidence"] == 0.96 and by[16, "No number"]["confidence"] == 0.9 and by[2, "Names x"]["section"] == "Std / 1.1 G.NAM.01 Names x"
    assert by[15, "必须 close everything here"]["severity"] == "major" and "x" not in by[2, "Names x"]["triggers"]
    named = {(r["doc_id"], r["line_start"]): (r["rule_id"], r["original_id"]) for r in extraction.qualify_ids(extraction.extract(docs)).collect()}
    assert named[1, 2] == ("安全-规范::G.NAM.01", "G.NAM.01") and named[2, 16] == ("b::G.X.02", "G.X.02") and len({v[0] for v in named.values()}) == len(named)


def test_ids_that_stay_equal_get_hashes_and_numbers(spark):
    rows = [("X.1", "a/d.md", "s", 1, "t"), ("x.1", "a/d.md", "s", 2, "t"), ("X.1", "a/d.md", "s", 2, "t"), ("X.1", "a/d.md", "s", 2, "t"), ("d::Y.1", "e.md", "s", 1, "t"), ("Y.1", "d.md", "s", 1, "t"), ("Y.1", "f.md", "s", 1, "t"), ("Z.1", "g.md", "s", 1, "t"), ("L" * 300, "g.md", "s", 1, "t"), ("L" * 300, "h.md", "s", 1, "t")]
    found = extraction.qualify_ids(spark.createDataFrame(rows, "rule_id string, document string, section string, line_start int, statement string")).collect()
    ids = [r["rule_id"] for r in found]
    assert len(ids) == 10 and len({i.lower() for i in ids}) == 10 and all(len(i) <= 240 for i in ids)
    assert {r["rule_id"] for r in found if r["original_id"] is None} == {"d::Y.1", "Z.1"}


def test_triggers_hints_and_enforcement(spark):
    text = "```java\ncode()\n```\nUse `Map.of` not 反序列化 @Transactional foo.bar(x) Config.yml 格式化 字符串; 必须同步修改 src/main"
    row = spark.createDataFrame([(text,)], "t string").select(lx.trigger_terms(F.col("t")).alias("t"), lx.retrieval_hints(F.col("t")).alias("h"), lx.direct_triggers(F.col("t")).alias("d"), lx.enforcement(F.col("t")).alias("e")).first()
    assert row["t"] == ["Map.of", "@Transactional", "foo.bar", "Config.yml"]
    assert row["h"][:2] == ["ObjectInputStream", "readObject"] and "占位符" in row["h"] and "Formatter" in row["d"] and len(set(row["h"])) == len(row["h"])
    assert row["e"] == ["coding_context", "change_set_check", "path_check", "static_check", "ai_review"]
    assert spark.range(1).select(lx.direct_triggers(F.lit("public class")).alias("d")).first()["d"] == []


def test_id_collisions(spark):
    rows = spark.createDataFrame([(1, "G.1"), (2, "g.1"), (3, "G.2")], "doc_id long, id string")
    assert {(r["doc_id"], r["n_same"], r["place"]) for r in extraction.collisions(rows, "id", ["doc_id"]).collect()} == {(1, 2, 1), (2, 2, 2)}


def test_edits_and_markup(spark):
    edits = F.array(*[F.struct(F.lit(a).alias("old"), F.lit(b).alias("new"), F.lit(c).alias("every")) for a, b, c in (("a", "b", False), ("b", "c", True), ("", "z", True), ("q", "z", False))])
    assert spark.range(1).select(apply_edits(F.lit("a a b"), edits)).first()[0] == "c a c"
    assert spark.range(1).select(strip_markup(F.lit("> **A** [b](u) ![i](p) <!-- x y --> c | d"))).first()[0] == "A b i c；d"
    for text, want in (("use List<String> when a < b and c > d", "use List<String> when a < b and c > d"), ("see <https://x.y/z> now", "see now"), ("| a | b |", "a；b")):
        assert spark.range(1).select(strip_markup(F.lit(text))).first()[0] == plain_text(text) == want
    assert plain_text("ＡＢＣ　１") == "ABC 1"
    titles = [(title, s) for title, s in (("A / Leaf", "short one。rest"), ("", "x" * 60), ("Leaf", "Leaf again"))]
    assert [r[0] for r in spark.createDataFrame(titles, "a string, b string").select(title_of(F.col("a"), F.col("b"))).collect()] == ["Leaf：short one", "规范候选：" + "x" * 41 + "…", "Leaf again"]


def test_normal_forms(spark):
    rows = spark.createDataFrame([(1, "Ｇetｔer Straße Σς"), (2, None)], "doc_id long, text string")
    found = {r["doc_id"]: (r["text"], r["low"]) for r in folded(normalised(rows, ["text"]), "text", "low").collect()}
    assert found == {1: ("Getter Straße Σς", "getter strasse σσ"), 2: (None, None)}
    assert {r["token"] for r in postings(normalised(rows, ["text"]), "doc_id", "text").collect()} >= {"getter"}


def test_sources(spark, tmp_path):
    folder = tmp_path / "company" / "deep"
    folder.mkdir(parents=True)
    (folder / "a.md").write_bytes("﻿必须 x".encode())
    (folder / "b.markdown").write_bytes("严禁".encode("gb18030"))
    (folder / "c.txt").write_text("no")
    found = {r["path"].rsplit("/", 1)[-1]: (r["text"], r["scope"]) for r in markdown.read_markdown(spark, str(tmp_path)).collect()}
    assert found == {"a.md": ("必须 x", "company"), "b.markdown": ("严禁", "company")}
    log = tmp_path / "log.jsonl"
    log.write_text(json.dumps({"event_id": "1", "event": "post_write_check", "results": [{"rule_id": "R1", "status": "fail"}]}) + "\n[1]\n{broken\n" + json.dumps({"event_id": "2"})[:-3])
    assert [r["event_id"] for r in records.read_events(spark, str(log)).collect()] == ["1"]
    bundle = tmp_path / "rules.json"
    bundle.write_text(json.dumps({"bundle_id": "a" * 64, "rules": [{"id": "A", "status": "approved", "confidence": 3.0}, {"id": "A", "status": "rejected"}]}, indent=1))
    rules = records.read_rules(spark, str(bundle))
    assert rules.orderBy(F.desc("status")).first()["id"] == "A" and rules.agg(F.max("confidence")).first()[0] == 1.0
    assert records.validate_bundle(rules) == ["rules that aren't approved", "ids that repeat"] and records.validate_bundle(rules.limit(0)) == ["empty bundle"]
    assert records.validate_bundle(rules.withColumn("bundle_id", F.col("id")).where("status = 'approved'")) == ["a bundle id that isn't 64 hexadecimal digits"]
    bare = tmp_path / "bare.json"
    bare.write_text(json.dumps([{"id": "A", "status": "approved", "confidence": -1.0}, {"id": "B"}], indent=1))
    assert {(r["id"], r["confidence"]) for r in records.read_rules(spark, str(bare)).collect()} == {("A", 0.0), ("B", 0.0)}
    records.write_approved(rules, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 1


def test_broadcast_only_behind_a_check(spark):
    big, small = spark.range(50), spark.range(5)
    assert "ResolvedHint" not in broadcast_if_small(big, 10)._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" in broadcast_if_small(small, 10)._jdf.queryExecution().analyzed().toString()


def test_latest_is_partial_before_the_shuffle(spark):
    results = spark.range(10).selectExpr("id % 2 as k", "'pass' as status", "id as seq")
    plan = audit.latest(results, ["k"], ["seq"])._jdf.queryExecution().executedPlan().toString()
    assert "partial_max_by" in plan


def test_stored_index_answers_alike_and_checks_its_manifest(spark, tmp_path):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "beta gamma gamma")], "doc_id long, text string")
    queries = retrieval.query_terms(spark.createDataFrame([(7, "gamma beta")], "query_id long, q string"), {"query": "q"})
    index = retrieval.build_index(docs)
    bundles.write_index(index, str(tmp_path / "ix"), "v1", "b" * 64, buckets=4)
    stored = bundles.read_index(spark, str(tmp_path / "ix"), "v1", "b" * 64)
    both = [sorted(map(tuple, retrieval.bm25(i, queries).collect())) for i in (index, stored)]
    assert both[0] == both[1] and len(both[0]) == 2
    with pytest.raises(ValueError):
        bundles.read_index(spark, str(tmp_path / "ix"), "v2")


def test_review_round_trip(spark):
    rules = spark.createDataFrame([("R1", "One", "do\nthis", "major", "d", 3, "a" * 64), ("R2", "Two", "that", "blocker", "d", 9, "b" * 64), ("R3", "Three", "x", "major", "d", 12, "c" * 64)], "rule_id string, title string, statement string, severity string, document string, line_start int, hash string")
    decisions = spark.createDataFrame([("R1", "approved"), ("R2", "modified")], "rule_id string, decision string")
    found = {r["rule_id"]: (r["review_hash"], r["decision"]) for r in bundles.parse_sections(bundles.review_sections(rules, decisions)).collect()}
    assert found == {"R1": ("a" * 64, "approved"), "R2": ("b" * 64, "missing_edit"), "R3": ("c" * 64, "pending_review")}
    both = spark.createDataFrame([("<!-- rule R9 " + "d" * 64 + " -->\n- [x] approved\n- [X] rejected",)], "markdown string")
    assert bundles.parse_sections(both).first()["decision"] == "conflict"


def test_bulk_approval_is_all_or_none(spark):
    rules = spark.createDataFrame([(f"R{i}", "pending_review") for i in range(300)] + [("X", "rejected")], "rule_id string, status string")
    ids = rules.where("rule_id <> 'X'").select("rule_id")
    assert bundles.approve_all(rules, ids).where("status = 'approved'").count() == 300
    for bad in (["X"], ["nobody"], ["R1", "R1"]):
        with pytest.raises(ValueError):
            bundles.approve_all(rules, spark.createDataFrame([(b,) for b in bad], "rule_id string"))


def test_session_summary(spark):
    result = "array<struct<rule_id:string,path:string,checker:string,status:string,blocking:boolean>>"
    rows = [("s", "1", "t1", "post_write_check", "a.java", ["R1"], [("R1", "a", "c", "fail", True), ("R2", "a", "c", "fail", False)]), ("s", "2", "t2", "post_write_check", None, None, [("R1", "a", "c", "pass", None)]), ("s", "3", "t3", "ai_review_self_attested", "b", ["AI1"], None)]
    events = spark.createDataFrame(rows, f"session_id string, event_id string, timestamp string, event string, path string, matched_rule_ids array<string>, results {result}")
    row = bundles.session_summary(events).first()
    assert (row["events"], row["changed_files"], row["failed_rule_ids"], row["blocking_failures"], row["attested_rule_ids"]) == (3, ["a.java"], ["R1", "R2"], 1, ["AI1"])
    assert [x["rule_id"] for x in row["resolved"]] == ["R1"] and [x["rule_id"] for x in row["unresolved"]] == ["R2"]


def test_decisions_without_a_valid_hash_approve_nothing(spark):
    rules = spark.createDataFrame([(i, f"s{i}", f"h{i}") for i in range(1, 9)] + [(8, "again", "h8")], "rule_id long, statement string, hash string")
    rows = [(1, "approved", None, None), (2, "approved", "old", None), (3, "modified", "h3", " "), (3, "approved", "h3", None), (4, "modified", "h4", ""), (5, "modified", "h5", "new"), (6, "rejected", "h6", None), (8, "approved", "h8", None), (99, "approved", "x", None)]
    decisions = spark.createDataFrame(rows, "rule_id long, decision string, review_hash string, edited string")
    found = {r["rule_id"]: (r["status"], r["statement"]) for r in review.apply(rules, decisions).collect()}
    assert found == {1: ("missing_hash", "s1"), 2: ("stale_hash", "s2"), 3: ("duplicate_decision", "s3"), 4: ("missing_edit", "s4"), 5: ("approved", "new"), 6: ("rejected", "s6"), 7: ("pending_review", "s7"), 8: ("duplicate_rule", "again"), 99: ("unknown_rule", None)}
    for part in ("rule_id = 1", "rule_id = 2", "rule_id = 5"):
        with pytest.raises(ValueError, match="refused"):
            review.apply_strict(rules.where("rule_id <= 2 OR rule_id = 5"), decisions.where(part))
    assert review.apply_strict(rules.where("rule_id = 5"), decisions.where("rule_id = 5")).first()["status"] == "approved"


def test_fingerprints_tell_fields_and_nulls_apart(spark):
    rows = spark.createDataFrame([("en", "x\nsource="), ("en\nsource=x", ""), ("en", None), ("en", ""), ("en", "")], "lang string, text string")
    hashes = [r[0] for r in rows.select(review.fingerprint({"lang": F.col("lang"), "text": F.col("text")})).collect()]
    assert len(set(hashes)) == 4 and hashes[3] == hashes[4]


def test_bundle_id_folds_alike(spark):
    rows = spark.range(500).select(F.col("id").alias("rule_id"), F.sha2(F.col("id").cast("string"), 256).alias("hash"))
    one, two = (review.bundle_id(rows, n).first() for n in (1, 4096))
    assert one["rule_count"] == two["rule_count"] == 500 and one["bundle_id"] == review.bundle_id(rows.orderBy(F.desc("rule_id")), 1).first()["bundle_id"]
    assert review.bundle_id(rows.where("rule_id < 499"), 1).first()["bundle_id"] != one["bundle_id"] and review.bundle_id(rows.limit(0)).count() == 1


def test_rounding_is_half_to_even(spark):
    rows = spark.createDataFrame([(1, 0.1234565)], "k long, x double")
    assert rows.groupBy("k").agg(F.bround(F.sum("x"), 6).alias("r")).first()["r"] == 0.123456


def test_scoring_with_bonuses_and_ties(spark):
    rows = [(1, "MAP-NULL", "", "major", ["Map.of"], "Map.of 不允许 null 集合"), (2, "MAP-COPY", "G.2", "blocker", [], "Map.copyOf 集合 拷贝"), (3, "POOL", "", "blocker", ["Map.of"], "线程池 管理"), (4, "A-TIE", "", "major", [], "集合 tie"), (5, "B-TIE", "", "blocker", [], "集合 tie")]
    rules = spark.createDataFrame(rows, "doc_id long, id string, original_id string, severity string, triggers array<string>, text string")
    queries = spark.createDataFrame([(1, "g.2 集合", "src/Foo.java", "Map.of(k)")], "query_id long, query string, path string, code string")
    index = retrieval.build_field_index(rules, {"statement": F.col("text")})
    terms = retrieval.query_terms(queries, {"query": "query", "path": "path", "code": "code"})
    ranked = retrieval.top_k(retrieval.score_rules(index, rules, queries, terms), 9, 0.0, [retrieval.severity_rank(F.col("severity")), "id"]).orderBy("rank").collect()
    assert [r["id"] for r in ranked] == ["MAP-COPY", "MAP-NULL", "B-TIE", "A-TIE"]  # POOL holds no term, so no bonus admits it
    plain = {r["doc_id"]: r["score"] for r in retrieval.bm25(index, terms).collect()}
    assert ranked[0]["score"] == pytest.approx(plain[2] + 12, abs=1e-6) and ranked[1]["score"] == pytest.approx(plain[1] + 2.5, abs=1e-6)
    assert retrieval.in_scope(rules, "severity", []).count() == retrieval.in_scope(rules, "severity", None).count() == 5 and retrieval.in_scope(rules, "severity", "MAJOR").count() == 2


def test_tool_calls(spark):
    def call(**fields):
        return (json.dumps(fields),)

    rows = [call(tool_name="Bash", tool_input={"command": c}) for c in ('echo x > "a b.java"', "cat a.java", "sed -i s/a/b/ x.XML", "git restore a.yml", "python -c \"open('a.xml').write('')\"", "rm notes.txt", "tee a.properties")]
    p = F.col("p")
    assert [r[0] for r in spark.createDataFrame(rows, "p string").select(payloads.shell_write(p)).collect()] == [True, False, True, True, True, False, True]
    rows = [call(tool_name="Edit", tool_input={"file_path": "a/b.Java"}, cwd="/w"), call(toolInput={"path": "/x/.java"}), call(tool_name="read", tool_input={"path": "x.java"}), call(sessionId=" a/b "), call(tool_response={"isError": "no"}, transcript_path="t")]
    found = spark.createDataFrame(rows, "p string").select(payloads.managed_write(p), payloads.target_path(p), payloads.session_id(p), payloads.tool_failed(p)).collect()
    assert [r[0] for r in found] == [True, False, False, False, False] and found[0][1] == "/w/a/b.Java" and found[3][2] == "a-b" and found[4][2].startswith("session-") and not found[4][3]


def test_imports_and_listings(spark, tmp_path):
    (tmp_path / "company").mkdir()
    (tmp_path / "other").mkdir()
    for name in ("company/a.md", "other/b.md", "c.md", "company/d.txt"):
        (tmp_path / name).write_text("x")
    assert [(r["scope"], r["name"], r["relative_path"]) for r in markdown.managed_documents(spark, str(tmp_path)).collect()] == [("company", "a.md", "company/a.md")]
    assert markdown.reports(spark, str(tmp_path), 2).count() == 2
    names = ["ok.md", "A.MD", "a.txt", "../x.md", " x.md", "con.md", "", None, "x\0.md", ".md", "dup.md", "dup.MD", "big.md", "void.md"]
    docs = spark.createDataFrame([("company", n, {"big.md": "x" * 99, "void.md": " "}.get(n, "t")) for n in names] + [("nowhere", "n.md", "t")], "scope string, name string, text string")
    found = [r["problem"] for r in markdown.import_problems(docs, markdown.managed_documents(spark, str(tmp_path)), 50).collect()]
    assert found.count(None) == 1 and len(found) == 15 and {"exists", "repeated", "too large", "empty", "a reserved name", "not a Markdown file", "unknown scope"} <= set(found)


def test_context_stays_within_its_budget(spark):
    rows = [(1, k, f"R{k}", "", "s" * 1000, "d.md / x", "d" * 5000, "", "p") for k in range(3)] + [(2, 0, "R", "major", "short", "", "", "", "")]
    found = bundles.context(spark.createDataFrame(rows, "query_id long, rank long, id string, level string, statement string, source string, description string, negative string, positive string"), 2400)
    by = {r["query_id"]: r["text"] for r in found.collect()}
    assert len(by[1]) <= 2400 and by[1].count("…") >= 3 and by[2] == "- [R] major short"


def test_merged_cards_and_stop_gate(spark):
    schema = "query_id long, id string, at long"
    direct, prepared, ranked = (spark.createDataFrame([(1, x, i) for i, x in enumerate(ids)], schema) for ids in (["a", "b", "c"], ["b", "d"], ["e", "a", ""]))
    assert [r["id"] for r in gates.merge_cards(direct, prepared, ranked, 2).orderBy("place").collect()] == ["a", "b", "c"]
    assert [(r["id"], r["origin"]) for r in gates.merge_cards(direct, prepared, ranked, 5).orderBy("place").collect()][3:] == [("d", "prepared"), ("e", "ranked")]
    results = spark.createDataFrame([(1, "R1", "fail", True), (2, "R1", "review", False), (2, "R2", "review", False), (3, "R1", "review", False), (4, "R1", "error", False)], "session_id long, rule_id string, status string, blocking boolean")
    proof = spark.createDataFrame([(2, "R1", True), (3, "R1", False), (3, "R1", True)], "session_id long, rule_id string, valid boolean")
    assert {r["session_id"]: r["outcome"] for r in gates.stop_gate(results, proof).collect()} == {1: "blocked", 2: "review_required", 3: "completed", 4: "blocked"}
    assert {r["session_id"]: r["outcome"] for r in gates.stop_gate(results, proof, False).collect()}[4] == "completed"
