"""Bundles: the stored index, core rules, context under a budget, review documents and session summaries."""

from __future__ import annotations

import importlib
import re
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.lexicon import source_label
from ..sources import snapshots
from .audit import FAILED, issues
from .extraction import Lexicon, extract, qualify_ids
from .ranking import index_to_store
from .retrieval import FIELD_REPEATS, Index, cosine, of_lengths, of_postings
from .review import apply_strict, bundle_id, decision_counts, reconcile
from .specs import draft_errors, rules_table

SCHEMA_VERSION = 1
SEVERITIES, SCOPES = ("blocker", "major", "advisory"), ("company", "department", "project", "unknown")


def write_index(index: Index, path: str, policy_version: str, bundle_id: str, buckets: int = 64) -> None:
    """Store an index: postings in ``buckets`` folders by token hash, sorted by token within files, and a manifest.

    The manifest is written last, so a reader never takes a half-written index for a whole one.
    """
    bucket = F.pmod(F.xxhash64("token"), F.lit(buckets)).cast("int")
    dealt = index.postings.withColumn("bucket", bucket).repartition("bucket").sortWithinPartitions("bucket", "token")
    dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    spark = index.postings.sparkSession
    if index.ids is not None:  # what follows comes from the stored postings, which are made once
        index = of_postings(spark.read.parquet(f"{path}/postings").drop("bucket"), index.ids)
    index.lengths.write.mode("overwrite").parquet(f"{path}/lengths")
    if index.ids is not None:
        index = replace(index, totals=of_lengths(index.ids, spark.read.parquet(f"{path}/lengths")))
    index.totals.write.mode("overwrite").parquet(f"{path}/totals")
    manifest = spark.read.parquet(f"{path}/totals").select(F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(policy_version).alias("policy_version"), F.lit(bundle_id).alias("bundle_id"), F.lit(buckets).alias("buckets"), F.col("n").alias("rule_count"))
    manifest.write.mode("overwrite").json(f"{path}/manifest")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The one row that describes a stored index."""
    return spark.read.schema("schema_version int, policy_version string, bundle_id string, buckets int, rule_count long").json(f"{path}/manifest")


def read_index(spark: SparkSession, path: str, policy_version: str | None = None, bundle_id: str | None = None, terms: DataFrame | None = None) -> Index:
    """Read a stored index after checking its manifest; a mismatch raises ``ValueError``.

    Given the queries' ``terms`` (a stated set), only the buckets that can hold their tokens are read.
    """
    row = manifest(spark, path).first()
    if row is None or row["schema_version"] != SCHEMA_VERSION:
        raise ValueError("no index of this schema version")
    if row["bundle_id"] and not re.fullmatch("[0-9a-f]{64}", row["bundle_id"]) or bundle_id is not None and not re.fullmatch("[0-9a-f]{64}", bundle_id.strip().lower()):
        raise ValueError("a bundle id has 64 hexadecimal digits")
    for name, want in (("policy_version", policy_version), ("bundle_id", bundle_id and bundle_id.strip().lower())):
        if want is not None and row[name] != want.strip():
            raise ValueError(f"index has {name} {row[name]}, not {want}")
    totals = spark.read.parquet(f"{path}/totals")
    if totals.first()["n"] != row["rule_count"]:
        raise ValueError("index and manifest disagree on the number of rules")
    found = spark.read.parquet(f"{path}/postings")
    if terms is not None:
        # At most one row for each bucket.
        wanted = [r["b"] for r in terms.select(F.pmod(F.xxhash64("token"), F.lit(row["buckets"])).cast("int").alias("b")).distinct().collect()]
        found = found.where(F.col("bucket").isin(wanted))
    return Index(found.drop("bucket"), spark.read.parquet(f"{path}/lengths"), totals)


def write_vectors(vectors: DataFrame, path: str, cells: int = 64, most_sample: int = 20_000) -> None:
    """Store vectors (``rule_id, v``) in cells around ``cells`` of them, so that a query reads the cells nearest to it.

    Centres are chosen by hash from at most ``most_sample`` vectors; every vector is stored with its nearest centre by cosine. Null and zero vectors are left out: they are like nothing.
    """
    usable = vectors.where(F.coalesce(F.size("v"), F.lit(0)) > 0).where(F.exists("v", lambda x: x != 0))
    centres = usable.limit(most_sample).orderBy(F.xxhash64("rule_id")).limit(cells).select("v").collect()  # at most ``cells``
    spark = vectors.sparkSession
    named = spark.createDataFrame([(i, list(r["v"])) for i, r in enumerate(centres)], "cell int, centre array<double>")
    pairs = usable.join(F.broadcast(named)).withColumn("near", cosine(F.col("v"), F.col("centre")))
    best = pairs.groupBy("rule_id").agg(F.max_by(F.struct("cell", "v"), F.struct("near", -F.col("cell"))).alias("x")).select("rule_id", "x.cell", "x.v")
    best.repartition("cell").write.partitionBy("cell").parquet(f"{path}/rows")
    named.coalesce(1).write.parquet(f"{path}/centres")


def read_vectors(spark: SparkSession, path: str, queries: DataFrame | None = None, probes: int = 8) -> DataFrame:
    """Stored vectors as ``doc_id, v``; given queries (``q``), only those of each query's ``probes`` nearest cells (all, if there are no more)."""
    rows = spark.read.schema("rule_id string, v array<double>, cell int").parquet(f"{path}/rows")
    if queries is not None:
        near = queries.join(F.broadcast(spark.read.parquet(f"{path}/centres"))).select("q", "cell", cosine(F.col("q"), F.col("centre")).alias("near"))
        chosen = near.groupBy("q").agg(F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("near", "cell")))), 1, probes).alias("x")).select(F.explode("x.cell").alias("cell")).distinct()
        rows = rows.where(F.col("cell").isin([r["cell"] for r in chosen.collect()]))  # at most as many as there are cells
    return rows.select(F.col("rule_id").alias("doc_id"), "v")


def core_rules(rules: DataFrame, limit: int = 40) -> DataFrame:
    """The rules for every context: those marked ``core``, then blockers outside project scope that aren't marked otherwise.

    ``rules`` has ``rule_id, severity, scope, core`` (boolean or null). Order: marked first, severity, scope, id.
    """
    chosen = rules.where(F.coalesce("core", F.lit(False)) | (F.col("core").isNull() & (F.col("severity") == "blocker") & (F.col("scope") != "project")))
    return chosen.orderBy(*_core_order()).limit(max(0, limit))


def _core_order() -> list[Column]:
    severity = F.coalesce(F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity")), F.lit(0))
    scope = F.coalesce(F.array_position(F.array(*map(F.lit, SCOPES)), F.col("scope")), F.lit(0))
    return [F.when(F.coalesce("core", F.lit(False)), 0).otherwise(1), F.when(severity == 0, 9).otherwise(severity), F.when(scope == 0, 9).otherwise(scope), F.col("rule_id")]


def within_budget(ranked: DataFrame, most_chars: int) -> DataFrame:
    """The foremost cards of each query whose texts together have at most ``most_chars`` characters; adds ``used``.

    ``ranked`` has ``query_id, rank, text``, with a bounded number of cards per query.
    """
    so_far = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ranked.withColumn("used", F.sum(F.length("text")).over(so_far)).where(F.col("used") <= most_chars)


def approve_all(rules: DataFrame, ids: DataFrame, most: int = 2000) -> DataFrame:
    """Approve pending rules by id, all or none: raises ``ValueError`` if an id is unknown, repeated or not pending."""
    state = ids.join(rules.select("rule_id", "status"), "rule_id", "left")
    row = state.agg(F.count("*").alias("n"), F.count_distinct("rule_id").alias("d"), F.count_if(F.coalesce(F.col("status") != "pending_review", F.lit(True))).alias("bad")).first()
    if row["n"] > most or row["n"] != row["d"] or row["bad"]:
        raise ValueError(f"{row['n']} ids, {row['d']} distinct, {row['bad']} unknown or not pending; at most {most}")
    chosen = ids.select("rule_id", F.lit(True).alias("_yes"))
    return rules.join(chosen, "rule_id", "left").withColumn("status", F.when(F.col("_yes"), "approved").otherwise(F.col("status"))).drop("_yes")


def review_sections(rules: DataFrame, decisions: DataFrame) -> DataFrame:
    """``document, line_start, rule_id, markdown``: one section for each rule, to be read by document (case apart), line and id.

    ``rules`` has ``rule_id, title, statement, severity, document, line_start, hash``; ``decisions`` has ``rule_id, decision`` and maybe ``edited, notes``.
    """
    mark = F.coalesce("decision", F.lit("pending_review"))
    boxes = [F.concat(F.lit("- ["), F.when(mark == d, "x").otherwise(" "), F.lit(f"] {d}")) for d in ("approved", "rejected", "modified", "needs_edit")]
    quote = F.concat(F.lit("> "), F.replace("statement", F.lit("\n"), F.lit("\n> ")))
    shown = decisions.select("rule_id", "decision", *[F.col(c) if c in decisions.columns else F.lit("").alias(c) for c in ("edited", "notes")])
    own = [F.concat(F.lit(f"<!-- {c} -->\n"), F.coalesce(c, F.lit("")), F.lit(f"\n<!-- /{c} -->")) for c in ("edited", "notes")]
    text = F.concat_ws("\n", F.concat(F.lit("## "), "rule_id", F.lit(" "), "title"), F.concat(F.lit("<!-- rule "), "rule_id", F.lit(" "), "hash", F.lit(" -->")), F.concat(F.lit("Severity: "), "severity"), quote, *boxes, *own)
    return rules.join(shown, "rule_id", "left").select("document", "line_start", "rule_id", text.alias("markdown"))


def in_review_order(sections: DataFrame) -> DataFrame:
    """Sections in the order in which a person reads them."""
    return sections.orderBy(F.lower("document"), "line_start", "rule_id")


def parse_sections(sections: DataFrame) -> DataFrame:
    """Decisions from sections (``markdown``): ``rule_id, review_hash, decision, edited, notes``.

    Several marks give ``conflict``, a modified rule without its new text ``missing_edit``: neither is ever taken for an approval.
    """
    rule = F.regexp_extract("markdown", r"<!-- rule (\S+) ([0-9a-f]{64}) -->", 1)
    found = F.regexp_extract_all("markdown", F.lit(r"(?m)^- \[[xX]\] (approved|rejected|modified|needs_edit)\s*$"), 1)
    edited, notes = (F.regexp_replace(F.regexp_extract("markdown", rf"(?s)<!-- {c} -->\n(.*?)\n?<!-- /{c} -->", 1), r"^\s+|\s+$", "") for c in ("edited", "notes"))
    decision = F.when(F.size(found) > 1, "conflict").when((F.get(found, F.lit(0)) == "modified") & (edited == ""), "missing_edit").otherwise(F.coalesce(F.get(found, F.lit(0)), F.lit("pending_review")))
    return sections.select(rule.alias("rule_id"), F.regexp_extract("markdown", r"<!-- rule (\S+) ([0-9a-f]{64}) -->", 2).alias("review_hash"), decision.alias("decision"), edited.alias("edited"), notes.alias("notes")).where("rule_id <> ''")


def cards(rules: DataFrame) -> DataFrame:
    """What a reader is shown of a rule: ``id, title, statement, severity, category, source``, severity and category never empty."""
    filled = lambda name, default: F.when(F.coalesce(name, F.lit("")) == "", default).otherwise(F.col(name)).alias(name)
    return rules.select("id", "title", "statement", filled("severity", "major"), filled("category", "coding"), source_label(F.col("document"), F.col("section")).alias("source"))


def context(found: DataFrame, most_chars: int = 12_000) -> DataFrame:
    """One text for each query, of its cards (``query_id, rank, id, level, statement, source, description, negative, positive``).

    Each card gets an even share of the budget, from 520 to 3,200 characters; statements and fields that are longer end in an ellipsis, and so
    does the whole if it is still too long. A query has a bounded number of cards.
    """
    # What the frame takes of the budget, the least and greatest share of a card, of its statement and of each of its fields.
    sized = found.withColumn("_n", F.count("*").over(Window.partitionBy("query_id")))
    share = F.least(F.lit(3200), F.greatest(F.lit(520), F.floor(F.lit(max(0, most_chars - 700)) / F.col("_n")))).cast("int")

    def cut(text: Column, most: Column) -> Column:
        return F.when(F.length(text) > most, F.concat(F.rtrim(F.substring(text, F.lit(1), most - 1)), F.lit("…"))).otherwise(text)

    sized = sized.withColumn("_share", share).withColumn("_s", cut(F.coalesce("statement", F.lit("")), F.least(F.lit(600), F.greatest(F.lit(180), F.floor(F.col("_share") / 4).cast("int")))))
    suffix = F.when(F.coalesce("source", F.lit("")) == "", "").otherwise(F.concat(F.lit(" ("), "source", F.lit(")")))
    fields = {n: F.nullif(F.coalesce(F.col(n), F.lit("")), F.lit("")) for n in ("description", "negative", "positive")}
    present = sum((f.isNotNull().cast("int") for f in fields.values()), F.lit(0))
    room = F.greatest(F.lit(100), F.floor(F.greatest(F.lit(0), F.col("_share") - F.length("_s") - F.length(suffix) - 80) / F.greatest(F.lit(1), present)).cast("int"))
    head = F.concat(F.lit("- ["), "id", F.lit("]"), F.when(F.coalesce("level", F.lit("")) == "", "").otherwise(F.concat(F.lit(" "), "level")), F.lit(" "), "_s", suffix)
    body = F.concat_ws("\n", head, *[F.concat(F.lit(f"  {n}: "), cut(f, room)) for n, f in fields.items()])
    whole = sized.select("query_id", "rank", body.alias("_text")).groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "_text"))), lambda x: x["_text"]), "\n").alias("text"), F.count("*").alias("n_cards"))
    return whole.withColumn("text", cut(F.col("text"), F.lit(most_chars)))


def core_block(rules: DataFrame, limit: int = 40, heading: str = "## Core rules") -> DataFrame:
    """One row ``markdown``: the core rules (``rule_id, statement, severity, scope, core``) as a list, or a line that says there are none."""
    chosen = core_rules(rules, limit)  # at most limit rows
    line = F.concat(F.lit("- `"), "rule_id", F.lit("`: "), "statement")
    order = _core_order()
    listed = chosen.select(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], line.alias("line")).alias("x")).agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]).alias("lines"))
    body = F.when(F.size("lines") == 0, "- none").otherwise(F.array_join("lines", "\n"))
    return listed.select(F.concat(F.lit(f"{heading}\n\n"), body, F.lit("\n")).alias("markdown"))


#: Where a bundle's rules are mirrored to: any callable that takes the rules and the bundle's id.
Sink = Callable[[DataFrame, str], None]


def load_sink(name: str) -> Sink:
    """The sink that ``module:function`` names."""
    module, _, function = name.partition(":")
    found = getattr(importlib.import_module(module), function, None) if module and function else None
    if not callable(found):
        raise ValueError(f"{name!r} names no sink: module:function is wanted")
    return found


#: What a rule's record doesn't hold: it changes without the rule's changing.
APART = ("status", "reviewer_notes")


def with_records(candidates: DataFrame, drafts: DataFrame | None = None) -> DataFrame:
    """Add ``record`` and its ``hash``: each candidate as a rule's record (canonical JSON, all but ``APART``).

    ``drafts`` (``rule_id, metadata``: a JSON object) adds to a rule's metadata what a person or provider wrote of it: checks, path scopes, ``global_core``. A name that both have is the draft's.
    """
    none = F.lit(None).cast("map<string,variant>")
    own = {"level": "level", "rule_number": "number", "description": "description", "negative_example": "negative", "positive_example": "positive", "retrieval_hints": "hints", "code_signals": "code_signals", "direct_triggers": "direct_triggers", "original_rule_id": "original_id"}
    structured = F.coalesce("structured", F.lit(False))
    meta = F.map_from_arrays(F.array(*[F.lit(n) for n in own]), F.array(*[F.to_json(F.to_variant_object(F.array(c))) for c in own.values()]))
    parsed = F.map_filter(F.transform_values(meta, lambda _, v: F.try_variant_get(F.parse_json(v), "$[0]", "variant")), lambda _, v: ~F.is_variant_null(v))
    basis = F.when(structured, F.map_concat(parsed, F.create_map(F.lit("structured_format"), F.parse_json(F.lit("true"))))).otherwise(F.map_filter(parsed, lambda k, _: k == "original_rule_id"))
    rows = candidates.join(drafts.select("rule_id", F.try_parse_json("metadata").try_cast("map<string,variant>").alias("_added")), "rule_id", "left") if drafts is not None else candidates.withColumn("_added", none)
    added = F.coalesce("_added", F.create_map().cast("map<string,variant>"))
    merged = F.map_concat(F.map_filter(basis, lambda k, _: ~F.map_contains_key(added, k)), added)
    source = F.struct("document", "section", "line_start", "line_end", "quote")
    whole = F.struct(F.col("rule_id").alias("id"), "title", "statement", "scope", "category", "severity", source.alias("source"), F.col("enforcement").alias("enforcement_candidates"), F.col("triggers").alias("trigger_terms"), "tags", "confidence", merged.alias("metadata"))
    return rows.withColumn("record", F.to_json(F.to_variant_object(whole))).withColumn("hash", F.sha2("record", 256)).drop("_added")


def read_records(rows: DataFrame) -> DataFrame:
    """Rules as columns from their ``record``: what is shown, ranked and indexed; other columns stay."""
    named = "id string, title string, statement string, scope string, category string, severity string, source struct<document:string,section:string,line_start:int,line_end:int,quote:string>, enforcement_candidates array<string>, trigger_terms array<string>, tags array<string>, confidence double, metadata struct<description:string,negative_example:string,positive_example:string,global_core:boolean,level:string,original_rule_id:string,direct_triggers:array<string>>"
    parsed = rows.withColumn("_r", F.from_json("record", named))
    r = F.col("_r")
    columns = {"title": r["title"], "statement": r["statement"], "scope": r["scope"], "category": r["category"], "severity": r["severity"], "document": r["source"]["document"], "section": r["source"]["section"], "line_start": r["source"]["line_start"], "line_end": r["source"]["line_end"], "quote": r["source"]["quote"], "enforcement": r["enforcement_candidates"], "triggers": r["trigger_terms"], "tags": r["tags"], "confidence": r["confidence"], "core": r["metadata"]["global_core"], "level": r["metadata"]["level"], "original_id": r["metadata"]["original_rule_id"], "direct_triggers": r["metadata"]["direct_triggers"], "description": r["metadata"]["description"], "negative": r["metadata"]["negative_example"], "positive": r["metadata"]["positive_example"]}
    return parsed.withColumns(columns).drop("_r")


def searchable(rules: DataFrame) -> Index:
    """The index of rules (:func:`read_records`): all that they say, each field counted as often as it weighs."""
    fields = {"id": F.col("rule_id"), "title": F.col("title"), "statement": F.col("statement"), "section": F.concat_ws(" ", "document", "section"), "triggers": F.array_join("triggers", " "), "tags": F.array_join("tags", " "), "category": F.col("category"), "scope": F.col("scope"), "metadata": F.concat_ws("\n", "description", "negative", "positive")}
    return index_to_store(rules, [(text, FIELD_REPEATS[name]) for name, text in fields.items()], "rule_id")


def prepare(documents: DataFrame, previous: DataFrame | None, decisions: DataFrame | None, path: str, lexicon: Lexicon = Lexicon(), drafts: DataFrame | None = None) -> DataFrame:
    """From documents (``doc_id, text, source``, maybe ``scope``) to a stored review: candidates, their hashes, and the decisions that still hold.

    Writes ``extracted``, ``candidates`` and ``review`` below ``path`` and returns the candidates with their ``record`` and its ``hash``. Decisions whose rule has changed in anything but its status and
    notes, or has gone, are stored as ``dropped``: nobody's work disappears unseen.
    """
    spark = documents.sparkSession
    extract(documents, lexicon).write.mode("overwrite").parquet(f"{path}/extracted")  # read several times below
    with_records(qualify_ids(spark.read.parquet(f"{path}/extracted")), drafts).write.mode("overwrite").parquet(f"{path}/candidates")
    stored = spark.read.parquet(f"{path}/candidates")
    none = spark.createDataFrame([], "rule_id string, decision string, review_hash string, edited string, notes string")
    held = reconcile(previous, decisions, stored) if previous is not None and decisions is not None else none.select("rule_id", "decision", F.lit("").alias("outcome"))
    held.where("outcome = 'dropped'").write.mode("overwrite").parquet(f"{path}/dropped")
    kept = held.where("outcome = 'preserved'").select("rule_id", "decision")
    review_sections(stored, kept).repartitionByRange(F.lower("document"), "line_start", "rule_id").sortWithinPartitions(F.lower("document"), "line_start", "rule_id").write.mode("overwrite").parquet(f"{path}/review")
    return stored


def rule_hashes(rules: DataFrame, policy_version: str) -> DataFrame:
    """``rule_id, hash`` of rules (``rule_id, record``) under a version: what a bundle's id is made of."""
    return rules.select("rule_id", F.sha2(F.concat_ws("\x1f", F.lit(policy_version), "record"), 256).alias("hash"))


def activate(candidates: DataFrame, decisions: DataFrame, path: str, policy_version: str, sink: Sink | None = None, core_limit: int = 40, vectors: DataFrame | None = None, block_severities: tuple[str, ...] = ("blocker",), after: Callable[[str], None] = lambda step: None) -> str:
    """From candidates and strict decisions to the active bundle: rules, compiled checks, core block and index in a version of its own; returns the bundle's id.

    Nothing is switched if a decision is refused, no rule is approved, a check's draft is wrong, or anything fails before all is written: readers keep the old
    bundle, which is never touched. ``vectors`` (``rule_id, v``) are stored beside the index. ``after`` is told of each step that is done.
    """
    spark = candidates.sparkSession
    seen = snapshots.current(spark, path)
    applied = apply_strict(candidates, decisions).where("status = 'approved'").select("rule_id", F.col("statement").alias("_statement"))
    approved = candidates.select("rule_id", "record").join(applied, "rule_id")
    # An edit is a new statement of the record; all else stays as it was reviewed.
    edited = F.to_json(F.to_variant_object(F.map_concat(F.map_filter(F.try_parse_json("record").try_cast("map<string,variant>"), lambda k, _: k != "statement"), F.create_map(F.lit("statement"), F.try_variant_get(F.parse_json(F.to_json(F.array("_statement"))), "$[0]", "variant")))))
    version = snapshots.new_version(path)
    approved.select("rule_id", F.lit("approved").alias("status"), edited.alias("record")).write.parquet(f"{version}/rules")
    rules = spark.read.parquet(f"{version}/rules")
    if rules.isEmpty():
        raise ValueError("no rule is approved; the active bundle stays")
    if wrong := [f"{r['rule_id']} check {r['check_no']}: {r['problem']}" for r in draft_errors(rules).limit(20).collect()]:
        raise ValueError("; ".join(wrong))
    name = bundle_id(rule_hashes(rules, policy_version)).first()["bundle_id"]
    after("rules")
    rules_table(rules, block_severities).write.parquet(f"{version}/checks")
    after("checks")
    shown = read_records(rules)
    core_block(shown.select("rule_id", "statement", "severity", "scope", "core"), core_limit).write.parquet(f"{version}/core")
    after("core")
    write_index(searchable(shown), f"{version}/index", policy_version, name)
    after("index")
    if vectors is not None:
        write_vectors(vectors.join(rules.select("rule_id"), "rule_id", "left_semi"), f"{version}/vectors")
        after("vectors")
    snapshots.switch(spark, path, version, seen, {"bundle_id": name, "policy_version": policy_version})
    after("switch")
    if sink is not None:
        sink(shown, name)
    return name


@dataclass(frozen=True)
class Bundle:
    """A bundle as it was when it was opened; a later activation doesn't change it."""

    bundle_id: str
    policy_version: str
    path: str
    rules: DataFrame
    checks: DataFrame

    def core(self) -> str:
        return self.rules.sparkSession.read.parquet(f"{self.path}/core").first()["markdown"]

    def index(self, terms: DataFrame | None = None) -> Index:
        return read_index(self.rules.sparkSession, f"{self.path}/index", self.policy_version, self.bundle_id, terms)

    def vectors(self, queries: DataFrame | None = None, probes: int = 8) -> DataFrame:
        return read_vectors(self.rules.sparkSession, f"{self.path}/vectors", queries, probes)


def read_bundle(spark: SparkSession, path: str) -> Bundle:
    """The active bundle after all checks: not empty, all approved, ids that don't repeat, and the fingerprint that its rules' whole records have now."""
    found = snapshots.current(spark, path)
    if found is None:
        raise ValueError("no bundle is active")
    rules = spark.read.parquet(f"{found.path}/rules")
    row = rules.agg(F.count("*").alias("n"), F.count_if(F.col("status") != "approved").alias("open"), F.count_distinct("rule_id").alias("ids")).first()
    if not row["n"] or row["open"] or row["ids"] < row["n"]:
        raise ValueError("the bundle is empty, repeats ids or holds rules that aren't approved")
    version = found.about["policy_version"]
    if bundle_id(rule_hashes(rules, version)).first()["bundle_id"] != found.about["bundle_id"]:
        raise ValueError("the bundle's rules aren't those that were activated")
    read_index(spark, f"{found.path}/index", version, found.about["bundle_id"])
    return Bundle(found.about["bundle_id"], version, found.path, read_records(rules), spark.read.parquet(f"{found.path}/checks"))


def status(candidates: DataFrame, decisions: DataFrame, active: DataFrame) -> DataFrame:
    """One row: candidates, pending, approved (modified ones included) and active rules, documents that have candidates."""
    counts = decision_counts(candidates, decisions)
    pending = F.coalesce(F.sum(F.when(F.col("decision") == "pending_review", F.col("n"))), F.lit(0))
    totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("candidates"), pending.alias("pending"), F.coalesce(F.sum("n_active"), F.lit(0)).alias("approved"))
    other = candidates.agg(F.count_distinct("document").alias("documents"))
    return totals.crossJoin(F.broadcast(other)).crossJoin(F.broadcast(active.agg(F.count_if(F.col("status") == "approved").alias("active"))))  # one row each


def session_summary(events: DataFrame) -> DataFrame:
    """One row for each session of an event log (``sources.records.EVENT``): counts, rule ids, files, open and settled issues.

    Results are exploded once; every list is an aggregation of distinct values, sorted.
    """
    base = events.withColumn("_seq", F.struct("timestamp", "event_id"))
    heads = base.groupBy("session_id").agg(
        F.count("*").alias("events"), F.sort_array(F.collect_set(F.when(F.col("event").isin("post_write_check", "write_observed", "pre_write_authorized") & (F.coalesce("path", F.lit("")) != ""), F.col("path")))).alias("changed_files"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set(F.coalesce("matched_rule_ids", F.array().cast("array<string>")))))).alias("matched_rule_ids"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set(F.when(F.col("event") == "ai_review_self_attested", F.col("matched_rule_ids")))))).alias("attested_rule_ids"),
    )
    results = base.select("session_id", "_seq", F.posexplode("results").alias("_pos", "r")).select("session_id", "_seq", "_pos", "r.rule_id", F.coalesce("r.path", F.lit("")).alias("path"), F.coalesce("r.checker", F.lit("")).alias("checker"), "r.status", F.coalesce("r.blocking", F.lit(False)).alias("blocking"))
    failed = results.groupBy("session_id").agg(F.sort_array(F.collect_set(F.when(F.col("status").isin(*FAILED), F.col("rule_id")))).alias("failed_rule_ids"), F.count_if(F.col("blocking") & F.col("status").isin(*FAILED)).alias("blocking_failures"))
    states = issues(results, ["session_id", "rule_id", "path", "checker"], ["_seq", "_pos"])
    listed = states.groupBy("session_id").agg(*[F.sort_array(F.collect_list(F.when(F.col("state") == s, F.struct("rule_id", "path", "checker")))).alias(s) for s in ("resolved", "unresolved")])
    return heads.join(failed, "session_id", "left").join(listed, "session_id", "left")
