"""Rules as a table, checks that keep apart, fingerprints of whole records, and bundles that switch at once or not at all."""

import fnmatch
import json
import random

import pytest
from pyspark.sql import functions as F

from normlake.functions.canonical import canonical_row
from normlake.functions.text import glob_pattern
from normlake.operators import bundles, checks, specs
from normlake.sources import snapshots

STANDARD = "# 安全\n\n## 1 G.SEC.01 禁止拼接 SQL 语句\n【级别】要求\n【描述】必须使用 `PreparedStatement` 反序列化\n【反例】a + b\n\n## 2 其他\n\n- 日志必须脱敏处理\n- 建议使用 `Map.of` 创建集合\n\n接口禁止返回 null 值。\n"


def table(spark, *records):
    return spark.createDataFrame([(json.dumps(r),) for r in records], "record string")


def test_two_checks_of_one_kind_keep_apart(spark):
    files = spark.createDataFrame([("a.txt", "only foo here"), ("b.txt", "bar\nbar")], "path string, content string")
    rules = specs.rules_table(table(spark, {"id": "R", "severity": "blocker", "checks": [{"type": "regex_forbid", "pattern": "foo", "message": "no foo"}, {"type": "regex_forbid", "pattern": "bar", "message": "no bar", "max_findings": 1, "severity": "advisory"}]}))
    found = {(r["path"], r["check_id"]): (r["status"], r["message"], r["evidence"], r["blocking"]) for r in checks.check_files(files, rules).collect()}
    assert found == {("a.txt", "R#1"): ("fail", "no foo", "foo", True), ("a.txt", "R#2"): ("pass", "", "", False), ("b.txt", "R#1"): ("pass", "", "", False), ("b.txt", "R#2"): ("fail", "no bar", "bar", False)}


def test_two_companions_of_one_rule_keep_apart(spark):
    rules = specs.rules_table(table(spark, {"id": "P", "severity": "blocker", "statement": "pair", "checks": [{"type": "companion_change", "trigger": "A.java", "requires": "A.xml"}, {"type": "companion_change", "trigger": ["B.java"], "requires": ["B.xml", "docs/*"]}]}))
    changes = spark.createDataFrame([(1, p, "") for p in ("A.java", "A.xml", "x\\B.java", "x/B.java")] + [(2, "docs/x", ""), (2, "B.java", None), (2, "B.xml", None)], "change_id long, path string, content string")
    found = {(r["change_id"], r["check_id"]): (r["status"], r["message"], r["blocking"], r["evidence"]) for r in checks.check_change_sets(changes, rules).collect()}
    assert found == {(1, "P#1"): ("pass", "", False, "A.java"), (1, "P#2"): ("fail", "pair；缺少：B.xml, docs/*", True, "x/B.java"), (2, "P#2"): ("pass", "", False, "B.java")}


def test_every_row_of_a_path_in_a_change_set_is_checked(spark):
    rules = specs.rules_table(table(spark, {"id": "R", "check": {"type": "regex_forbid", "pattern": "foo"}}, {"id": "P", "statement": "pair", "check": {"type": "companion_change", "trigger": "A.java", "requires": "A.xml"}}))
    changes = spark.createDataFrame([(1, "A.java", "clean"), (1, "./A.java", "foo\nfoo"), (1, "b", "foo"), (1, "b", "foo"), (1, "c", None), (2, "A.java", "foo")], "change_id long, path string, content string")
    found = [(r["change_id"], r["check_id"], r["path"], r["status"], r["line"], r["evidence"]) for r in checks.check_change_sets(changes, rules).collect()]
    lone = [(i, "P#1", "A.java", "fail", 0, "A.java") for i in (1, 2)]
    assert sorted(found) == sorted([*lone, (1, "R#1", "A.java", "pass", 0, ""), (1, "R#1", "A.java", "fail", 1, "foo"), (1, "R#1", "A.java", "fail", 2, "foo"), (1, "R#1", "b", "fail", 1, "foo"), (1, "R#1", "b", "fail", 1, "foo"), (1, "R#1", "c", "pass", 0, ""), (2, "R#1", "A.java", "fail", 1, "foo")])


def test_many_checks_are_judged_once_for_each_condition(spark, monkeypatch):
    kinds = [("**/en/*", "", (), "a"), ("**/en/*", "", (), "b"), ("", "<h1>", (), "a"), ("", "", ("TABLE", "x"), "c"), ("", "", (), "a")]
    rules = checks.rules_frame(spark, [checks.Rule(f"R{i}", "regex_forbid", (p,), include=(g,) if g else (), when_pattern=w, when_terms=t, triggers=("nav",), severity="blocker") for i, (g, w, t, p) in enumerate(kinds * 3)])
    files = spark.createDataFrame([(1, "x/en/a", "<h1> a nav"), (2, "b", None), (3, "x/en/c", "a table"), (3, "x/en/c", "a table")], "page_id long, path string, content string")
    plain = [sorted(map(tuple, f(files, rules, keep=["page_id"]).collect()), key=str) for f in (checks.verdicts, checks.findings, checks.applicable)]
    monkeypatch.setattr(checks, "MOST_BROADCAST", 2)
    assert [sorted(map(tuple, f(files, rules, keep=["page_id"]).collect()), key=str) for f in (checks.verdicts, checks.findings, checks.applicable)] == plain and all(plain)
    joins = [x for x in checks.applies(files, rules)._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join Inner" in x]
    assert "include" in joins[0] and "rlike" not in joins[0].lower()  # rules meet the pairs by equality


def test_declarations(spark):
    record = {"id": " R ", "statement": "s", "include_paths": ["r"], "tags": ["t", "", None, 0], "trigger_terms": "w", "metadata": {"path_globs": "m", "excluded_paths": ["x"]}, "checks": [{"type": "Regex_Forbid", "regex": "a", "path_glob": "s", "flags": "i, multiline,bogus", "max_findings": 0, "blocking": None}, "ai_review", {"checker": "path_allow", "allow": ["p", " "], "patterns": ["q"], "blocking": False, "require_all": None}, 7, "nonsense"]}
    rows = {r["check_id"]: r for r in specs.rules_table(table(spark, record)).collect()}
    one, two, three = rows["R#1"], rows["R#2"], rows["R#3"]
    assert (one["kind"], one["patterns"], one["include"], one["exclude"], one["most_findings"], one["blocking"]) == ("regex_forbid", ["(?ium)a"], ["(?s)^s$"], ["(?s)^x$"], 3, None) and (two["kind"], two["include"], two["message"]) == ("ai_review", ["(?s)^m$"], "s")
    assert (three["named"], three["blocking"], three["require_all"], three["triggers"]) == (["p"], False, False, ["w", "t"]) and len(rows) == 3
    values = spark.createDataFrame([("10",), ('["dotall", "X"]',), ("null",), ('"i"',), ("3.5",)], "j string").select(specs.flag_letters(F.parse_json("j")).alias("f"))
    assert [r["f"] for r in values.collect()] == ["im", "sx", "", "i", "i"]
    kinds = specs.rules_table(table(spark, {"id": "A"}, {"id": "B", "metadata": {"enforcement_disabled": True}}, {"id": "C", "enforcement_candidates": ["path_forbid", "coding_context"], "metadata": {"paths": "p"}}, {"id": "D", "status": "Approved", "check": {"type": "ai_review"}}, {"id": "E", "status": "rejected"}, {"statement": "no id"}))
    assert {(r["rule_id"], r["kind"], tuple(r["named"])) for r in kinds.collect()} == {("A", "ai_review", ()), ("B", "ai_review", ()), ("C", "path_forbid", ("p",)), ("D", "ai_review", ()), ("UNKNOWN-RULE", "ai_review", ())}
    assert {r["rule_id"] for r in checks.check_files(spark.createDataFrame([("a", "")], "path string, content string"), kinds).collect()} == {"A", "C", "D", "UNKNOWN-RULE"}
    assert specs.rules_table(spark.createDataFrame([("nonsense",), ("[1]",), (None,), ("5",)], "record string")).count() == 0
    found = specs.configured(table(spark, record, {"id": "OK"}, {"id": "C", "enforcement_candidates": ["path_forbid", "coding_context"]}, {"id": "B", "metadata": {"enforcement_disabled": True}}))
    assert {r["rule_id"]: r["configured"] for r in found.collect()} == {"R": True, "OK": False, "C": True, "B": False}


def test_draft_errors_and_refused_patterns_are_rows(spark):
    bad = ("(a+)+$", "x" * 2001, r"(?:[a-z]+\d)*", r"(a{2,})+", "(", "(?<n>a)(?<n>b)")
    drafts = [{"id": f"B{i}", "check": {"type": "regex_require", "pattern": p}} for i, p in enumerate(bad)] + [{"id": "E", "check": []}, {"id": "N", "check": {"type": "companion_change", "trigger": "a"}}, {"id": "X", "checks": [7, "nonsense", {"type": "ai_review", "when_pattern": "["}]}, {"id": "OK", "check": {"type": "regex_forbid", "pattern": r"(\+)+(?P<n>a)(?P=n)"}}, {"id": "NONE"}, {"id": "NULL", "check": None}]
    found = {(r["rule_id"], r["check_no"]): r["problem"] for r in specs.draft_errors(table(spark, *drafts)).collect()}
    assert [found[f"B{i}", 1].split()[0] for i in range(6)] == ["nested", "pattern", "nested", "nested", "invalid", "invalid"]
    assert {k: v for k, v in found.items() if k[0][0] != "B"} == {("E", 0): "no check declared", ("NULL", 0): "no check declared", ("N", 1): "companion_change lacks its patterns", ("X", 1): "neither a name nor an object", ("X", 2): "unknown type nonsense", ("X", 3): "invalid pattern"}
    files = spark.createDataFrame([("a.txt", "+aa")], "path string, content string")
    rows = {r["rule_id"]: (r["status"], r["blocking"]) for r in checks.check_files(files, specs.rules_table(table(spark, *drafts))).collect()}
    assert all(rows[f"B{i}"] == ("error", True) for i in range(6)) and rows["X"] == ("error", True) and rows["OK"] == ("fail", False)


def test_a_rule_is_shown_once_with_the_kinds_of_its_checks(spark):
    rules = specs.rules_table(table(spark, {"id": "M", "severity": "blocker", "tags": ["Foo"], "checks": [{"type": "path_forbid", "paths": ["*.tmp"], "include_paths": ["*.java"]}, {"type": "ai_review", "when_terms": "class"}, {"type": "regex_forbid", "pattern": "x", "when_pattern": "["}, {"type": "path_allow", "paths": "*", "include_paths": ["*.md"]}]}, {"id": "QUIET"}))
    files = spark.createDataFrame([("a.java", "class foo"), ("b.txt", "")], "path string, content string")
    found = {(r["path"], r["rule_id"]): (r["score"], r["checkers"]) for r in checks.applicable(files, rules).collect()}
    assert found == {("a.java", "M"): (1 + 4 + 3 + 3 + 2, ["ai_review", "path_forbid"])}


def test_globs_are_those_of_fnmatch(spark):
    draw = random.Random(3)
    word = lambda letters, least, most: "".join(draw.choice(letters) for _ in range(draw.randrange(least, most)))
    pairs = {(draw.choice(["", "", "**/", "*"]) + word("ab*?[]!^.&|(/", 0, 7), word("ab.!^&|([]/", 1, 6)) for _ in range(3000)}
    pairs = [(g, p) for g, p in pairs if "//" not in g and not g.startswith("./")] + [("[]a]", "]"), ("[!]a]", "b"), ("[!]", "[!]"), ("[a-c]x", "bx"), ("a[", "a["), ("[[]", "["), ("[^a]", "^")]
    rows = spark.createDataFrame(pairs, "g string, p string").select("g", "p", F.call_function("rlike", F.col("p"), glob_pattern(F.col("g"))).alias("hit")).collect()
    wrong = [tuple(r) for r in rows if r["hit"] != (fnmatch.fnmatchcase(r["p"], r["g"]) or r["g"].startswith("**/") and fnmatch.fnmatchcase(r["p"], r["g"][3:]))]
    # A leading **/ also means any folders at all.
    assert not [w for w in wrong if not w[0].startswith("**/")] and len(wrong) < 30 and sum(r["hit"] for r in rows) > 50


def test_canonical_json(spark):
    rows = spark.sql("select 2 as b, map(3, struct(cast(null as string) as z, 1 as a), 1, null) as m, array(struct(2.50 as q, 'é\"' as p)) as l, cast(null as string) as A, X'00ff' as x, double('NaN') as n, interval 1 day as i")
    text = rows.select(canonical_row(rows, ("n",)).alias("t")).first()["t"]
    assert text == '{"A":null,"b":2,"i":"INTERVAL \'1\' DAY","l":[{"p":"é\\"","q":2.5}],"m":{"1":null,"3":{"a":1,"z":null}},"x":"AP8="}'
    assert rows.select(*reversed(rows.columns)).select(canonical_row(rows, ("n",))).first()[0] == text


#: SQL for another value of each field.
FIELDS = {n: "'other'" for n in ("title", "statement", "scope", "category", "severity", "document", "section", "quote", "level", "number", "description", "negative", "positive")}
FIELDS |= {n: "array('other')" for n in ("enforcement", "triggers", "tags", "hints", "code_signals", "direct_triggers")} | {"line_start": "9", "line_end": "99", "confidence": "0.5d"}


@pytest.fixture(scope="module")
def candidates(spark, tmp_path_factory):
    docs = spark.createDataFrame([(1, STANDARD, "a.md", "company"), (2, STANDARD, "b.md", "Project")], "doc_id long, text string, source string, scope string")
    return bundles.prepare(docs, None, None, tmp_path_factory.mktemp("work").as_uri()).cache()


def test_extracted_records_are_whole(spark, candidates):
    rows = {(r["document"], r["title"]): json.loads(r["record"]) for r in candidates.collect()}
    rule = rows["a.md", "禁止拼接 SQL 语句"]
    assert (rule["id"], rule["scope"], rule["source"]["line_start"]) == ("a::G.SEC.01", "company", 3) and rule["source"]["quote"].startswith("## 1 G.SEC.01") and "ObjectInputStream" in rule["metadata"]["direct_triggers"]
    assert "PreparedStatement" in rule["metadata"]["code_signals"] and rule["metadata"]["structured_format"] is True and rule["metadata"]["original_rule_id"] == "G.SEC.01"
    prose = next(r for (d, t), r in rows.items() if d == "b.md" and "脱敏" in t)
    assert prose["scope"] == "project" and prose["metadata"] == {} and "脱敏" in prose["source"]["quote"]


@pytest.mark.parametrize("field", sorted(FIELDS))
def test_a_change_in_any_field_changes_both_fingerprints(spark, candidates, field):
    one = candidates.where("structured").limit(1).drop("record", "hash")
    shown = lambda df: bundles.with_records(df).select("rule_id", "record", "hash")
    before, after = shown(one).first(), shown(one.withColumn(field, F.expr(FIELDS[field]))).first()
    assert before["hash"] != after["hash"]
    ids = [bundles.bundle_id(bundles.rule_hashes(spark.createDataFrame([r]), "v")).first()["bundle_id"] for r in (before, after)]
    assert ids[0] != ids[1]


def test_status_and_notes_change_none(spark, candidates):
    one = candidates.drop("record", "hash").limit(1)
    assert bundles.with_records(one.withColumn("status", F.lit("approved")).withColumn("reviewer_notes", F.lit("n"))).first()["hash"] == bundles.with_records(one).first()["hash"]


def test_drafts_are_part_of_what_is_reviewed(spark, candidates):
    plain = candidates.drop("record", "hash").where("structured and document = 'a.md'")
    name = plain.first()["rule_id"]
    drafts = spark.createDataFrame([(name, json.dumps({"checks": [{"type": "regex_forbid", "pattern": "x"}], "level": "changed"}))], "rule_id string, metadata string")
    found = json.loads(bundles.with_records(plain, drafts).first()["record"])
    assert found["metadata"]["checks"][0]["pattern"] == "x" and found["metadata"]["level"] == "changed" and "description" in found["metadata"]


def decided(candidates, approve):
    sections = bundles.review_sections(candidates, candidates.sparkSession.createDataFrame([], "rule_id string, decision string"))
    box = F.when(approve, "approved").otherwise("rejected")
    return bundles.parse_sections(sections.withColumn("markdown", F.replace("markdown", F.concat(F.lit("- [ ] "), box), F.concat(F.lit("- [x] "), box))))


def test_a_bundle_holds_its_checks_core_and_scopes(spark, candidates, tmp_path):
    structured = candidates.where("structured").select("rule_id")
    drafts = structured.select("rule_id", F.lit('{"checks": [{"type": "regex_forbid", "pattern": "a"}, {"type": "regex_forbid", "pattern": "b"}], "global_core": true}').alias("metadata"))
    whole = bundles.with_records(candidates.drop("record", "hash"), drafts).cache()
    live, sent = tmp_path.as_uri(), []
    name = bundles.activate(whole, decided(whole, F.col("document") == "a.md"), live, "v1", sink=lambda rules, bundle: sent.append((rules.count(), bundle)))
    bundle = bundles.read_bundle(spark, live)
    assert (bundle.bundle_id, bundle.policy_version, sent) == (name, "v1", [(4, name)]) and bundle.rules.count() == 4
    assert [(r["check_id"], r["patterns"]) for r in bundle.checks.where("kind = 'regex_forbid'").orderBy("check_no").collect()] == [("a::G.SEC.01#1", ["a"]), ("a::G.SEC.01#2", ["b"])]
    assert "- `a::G.SEC.01`: " in bundle.core() and {r["scope"] for r in bundle.rules.collect()} == {"company"}
    assert bundle.index().lengths.count() == 4
    # A blocker of a project isn't core by itself.
    bundles.activate(candidates, decided(candidates, F.col("document") == "b.md"), live, "v2")
    later = bundles.read_bundle(spark, live)
    assert "- none" in later.core() and later.policy_version == "v2"
    # A reader stays with what it has opened until that is vacuumed away.
    assert bundle.rules.count() == 4 and bundle.index().lengths.count() == 4 and len(snapshots.vacuum(spark, live, keep=1)) == 1
    assert bundles.read_bundle(spark, live).bundle_id == later.bundle_id
    row = bundles.status(candidates, decided(candidates, F.col("document") == "b.md"), later.rules).first()
    assert (row["candidates"], row["approved"], row["documents"], row["active"]) == (8, 4, 2, 4)


def test_what_keeps_a_bundle_from_being_activated(spark, candidates, tmp_path):
    live = tmp_path.as_uri()
    with pytest.raises(ValueError, match="no bundle"):
        bundles.read_bundle(spark, live)
    with pytest.raises(ValueError, match="approved"):
        bundles.activate(candidates, decided(candidates, F.lit(False)), live, "v1")
    drafts = candidates.where("structured").select("rule_id", F.lit('{"check": {"type": "companion_change"}}').alias("metadata"))
    wrong = bundles.with_records(candidates.drop("record", "hash"), drafts).cache()
    with pytest.raises(ValueError, match="companion_change lacks"):
        bundles.activate(wrong, decided(wrong, F.lit(True)), live, "v1")
    with pytest.raises(ValueError, match="stale"):
        bundles.activate(wrong, decided(candidates, F.lit(True)), live, "v1")
    assert snapshots.current(spark, live) is None


def test_a_crash_at_any_step_leaves_the_old_bundle(spark, candidates, tmp_path):
    live = tmp_path.as_uri()
    old = bundles.activate(candidates, decided(candidates, F.col("document") == "a.md"), live, "v1")
    for step in ("rules", "checks", "core", "index"):
        def die(done, step=step):
            if done == step:
                raise RuntimeError("killed")

        with pytest.raises(RuntimeError):
            bundles.activate(candidates, decided(candidates, F.lit(True)), live, "v2", after=die)
        assert bundles.read_bundle(spark, live).bundle_id == old
    seen = snapshots.current(spark, live)
    # A pointer whose writer died before it said anything doesn't count, and the next number is taken.
    (tmp_path / "pointers" / f"{seen.number + 1:012d}").write_text("")
    assert bundles.read_bundle(spark, live).bundle_id == old
    new = bundles.activate(candidates, decided(candidates, F.lit(True)), live, "v2")
    assert bundles.read_bundle(spark, live).bundle_id == new != old and snapshots.current(spark, live).number == seen.number + 2


def test_of_two_activations_one_wins(spark, candidates, tmp_path):
    live = tmp_path.as_uri()
    first = []

    def other(step):
        if step == "index" and not first:
            first.append(bundles.activate(candidates, decided(candidates, F.col("document") == "b.md"), live, "v1"))

    with pytest.raises(snapshots.Superseded):
        bundles.activate(candidates, decided(candidates, F.lit(True)), live, "v2", after=other)
    assert bundles.read_bundle(spark, live).bundle_id == first[0]


def test_a_bundle_that_was_changed_is_refused(spark, candidates, tmp_path):
    live = tmp_path.as_uri()
    bundles.activate(candidates, decided(candidates, F.lit(True)), live, "v1")
    place = snapshots.current(spark, live).path + "/rules"
    rules = [r.asDict() for r in spark.read.parquet(place).collect()]
    for change in ({"record": rules[0]["record"].replace('"major"', '"advisory"').replace('"blocker"', '"major"')}, {"status": "rejected"}):
        spark.createDataFrame([rules[0] | change, *rules[1:]], "rule_id string, status string, record string").write.mode("overwrite").parquet(place)
        with pytest.raises(ValueError):
            bundles.read_bundle(spark, live)


def test_an_edit_becomes_the_statement_of_the_record(spark, candidates, tmp_path):
    marks = decided(candidates, F.lit(False)).where("rule_id <> 'a::G.SEC.01'").unionByName(candidates.where("rule_id = 'a::G.SEC.01'").select("rule_id", F.col("hash").alias("review_hash"), F.lit("modified").alias("decision"), F.lit('say "no" \\ 不').alias("edited"), F.lit("").alias("notes")))
    bundles.activate(candidates, marks, tmp_path.as_uri(), "v1")
    row = bundles.read_bundle(spark, tmp_path.as_uri()).rules.first()
    assert row["statement"] == 'say "no" \\ 不' and row["section"].endswith("禁止拼接 SQL 语句")


def test_stored_vectors_are_read_by_cells(spark, tmp_path):
    rows = [(f"R{i}", [1.0 if k == i % 4 else 0.01 * (i % 7) for k in range(4)]) for i in range(60)] + [("NULL", None), ("ZERO", [0.0] * 4)]
    bundles.write_vectors(spark.createDataFrame(rows, "rule_id string, v array<double>"), tmp_path.as_uri(), cells=8)
    assert bundles.read_vectors(spark, tmp_path.as_uri()).count() == 60
    queries = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0])], "query_id long, q array<double>")
    near = {r["doc_id"] for r in bundles.read_vectors(spark, tmp_path.as_uri(), queries, 4).collect()}
    assert {f"R{i}" for i in range(0, 60, 28)} <= near and len(near) < 60
