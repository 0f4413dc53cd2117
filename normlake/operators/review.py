"""Review: content hashes, reconciling and applying decisions, bundles, caches and mirrors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.payloads import canonical

def fingerprint(fields: dict[str, Column]) -> Column:
    """SHA-256 of the fields as canonical JSON: other values, and null for empty, give another hash. Status and notes are left out by the caller."""
    return F.sha2(canonical(fields), 256)


def decision_fingerprint() -> Column:
    """The hash of a decision as shown, by which a later change is refused if someone else came first."""
    return fingerprint({c: F.col(c) for c in ("rule_id", "decision", "review_hash", "edited", "notes")})


def update_decisions(current: DataFrame, updates: DataFrame) -> DataFrame:
    """Compare and set: ``rule_id, decision, outcome``. An update (``rule_id, expected, decision``) counts if ``expected`` is the current decision's hash.

    Outcomes: updated, conflict (it has changed, or the batch changes it twice), unknown; decisions without an update stay (kept).
    """
    asked = updates.groupBy("rule_id").agg(F.count("*").alias("_n"), F.min("expected").alias("_expected"), F.min("decision").alias("_new"))
    held = current.select("rule_id", "decision", decision_fingerprint().alias("_hash"))
    outcome = F.when(F.col("_n").isNull(), "kept").when(F.col("_hash").isNull(), "unknown").when((F.col("_n") == 1) & F.col("_expected").eqNullSafe(F.col("_hash")), "updated").otherwise("conflict")
    return held.join(asked, "rule_id", "full").select("rule_id", F.when(outcome == "updated", F.col("_new")).otherwise(F.col("decision")).alias("decision"), outcome.alias("outcome"))


def _user_work(decision: Column, edited: Column, notes: Column) -> Column:
    return (decision != "pending_review") | (F.coalesce(edited, F.lit("")) != "") | (F.coalesce(notes, F.lit("")) != "")


def reconcile(old: DataFrame, decisions: DataFrame, new: DataFrame) -> DataFrame:
    """Carry decisions over to rules that haven't changed: ``rule_id, decision, outcome`` (preserved or dropped).

    ``old`` and ``new`` have ``rule_id, hash``; ``decisions`` has ``rule_id, decision, review_hash, edited,
    notes``. Preserved: the decision's hash is the old rule's and the new rule's. Dropped: other
    decisions that hold a person's work. Untouched pending decisions are neither.
    """
    joined = decisions.join(old.select("rule_id", F.col("hash").alias("old_hash")), "rule_id", "left").join(new.select("rule_id", F.col("hash").alias("new_hash")), "rule_id", "left")
    same = (F.col("review_hash") == F.col("old_hash")) & (F.col("old_hash") == F.col("new_hash"))
    outcome = F.when(F.coalesce(same, F.lit(False)), "preserved").otherwise("dropped")
    return joined.where(_user_work(F.col("decision"), F.col("edited"), F.col("notes"))).select("rule_id", "decision", outcome.alias("outcome"))


#: What keeps a batch of decisions from being applied.
REFUSED = ("unknown_rule", "duplicate_rule", "duplicate_decision", "missing_hash", "stale_hash", "missing_edit")


def apply(rules: DataFrame, decisions: DataFrame) -> DataFrame:
    """Rules with their status after the decisions; a missing decision leaves a rule pending, modified ones take the edit.

    ``rules`` has ``rule_id, statement, hash``. One row for each rule id; what is wrong comes as a status in ``REFUSED``, never as an
    approval: the caller refuses the batch if there is any (:func:`apply_strict`).
    """
    d = decisions.groupBy("rule_id").agg(F.count("*").alias("_d"), F.first("decision").alias("decision"), F.first("review_hash").alias("review_hash"), F.first("edited").alias("edited"))
    r = rules.groupBy("rule_id").agg(F.count("*").alias("_r"), F.min("hash").alias("hash"))
    status = (
        F.when(F.col("hash").isNull(), "unknown_rule")
        .when(F.col("_r") > 1, "duplicate_rule")
        .when(F.col("_d").isNull(), "pending_review")
        .when(F.col("_d") > 1, "duplicate_decision")
        .when(F.coalesce("review_hash", F.lit("")) == "", "missing_hash")
        .when(F.col("review_hash") != F.col("hash"), "stale_hash")
        .when((F.col("decision") == "modified") & (F.coalesce("edited", F.lit("")) == ""), "missing_edit")
        .when(F.col("decision") == "modified", "approved")
        .otherwise(F.coalesce("decision", F.lit("pending_review")))
    )
    judged = r.join(d, "rule_id", "full").select("rule_id", status.alias("status"), F.when(F.col("decision") == "modified", F.col("edited")).alias("_edit"))
    texts = rules.groupBy("rule_id").agg(F.min("statement").alias("statement"))
    return judged.join(texts, "rule_id", "left").select("rule_id", "status", F.when((F.col("status") == "approved") & F.col("_edit").isNotNull(), F.col("_edit")).otherwise(F.col("statement")).alias("statement"))


def apply_strict(rules: DataFrame, decisions: DataFrame) -> DataFrame:
    """:func:`apply`, or ``ValueError`` with the counts of what is wrong; every rule needs a decision."""
    found = apply(rules, decisions)
    wrong = {r["status"]: r["n"] for r in found.where(F.col("status").isin(*REFUSED)).groupBy("status").agg(F.count("*").alias("n")).collect()}  # REFUSED has six
    open_ = rules.select("rule_id").join(decisions.select("rule_id"), "rule_id", "left_anti").count()
    if wrong or open_:
        raise ValueError(f"decisions refused: {wrong | ({'missing_decision': open_} if open_ else {})}")
    return found


def decision_counts(rules: DataFrame, decisions: DataFrame) -> DataFrame:
    """``decision, n, n_active`` over all rules (``rule_id``); a rule without a decision is pending; approved and modified ones are active."""
    decision = F.coalesce("decision", F.lit("pending_review"))
    joined = rules.select("rule_id").join(decisions.select("rule_id", "decision"), "rule_id", "left").select(decision.alias("decision"))
    return joined.groupBy("decision").agg(F.count("*").alias("n"), F.count_if(F.col("decision").isin("approved", "modified")).alias("n_active"))


def rule_view(rules: DataFrame, decisions: DataFrame) -> DataFrame:
    """Rules (``rule_id, statement, hash``) beside their decisions, with both hashes; a rule without one shows an untouched pending decision."""
    held = decisions.select("rule_id", "decision", "review_hash", "edited", "notes", decision_fingerprint().alias("decision_hash"))
    joined = rules.select("rule_id", "statement", F.col("hash").alias("rule_hash")).join(held, "rule_id", "left")
    return joined.select("rule_id", "statement", "rule_hash", F.coalesce("decision", F.lit("pending_review")).alias("decision"), F.coalesce("edited", F.lit("")).alias("edited"), F.coalesce("notes", F.lit("")).alias("notes"), F.coalesce(F.col("review_hash") == F.col("rule_hash"), F.lit(False)).alias("current"), "decision_hash")


def matching(rows: DataFrame, text: str, fields: list[str], **wanted: str | list[str]) -> DataFrame:
    """Rows one of whose ``fields`` holds ``text`` (case apart) and whose other columns have the wanted values; ``accepted`` is approved or modified."""
    out = rows.where(F.contains(F.lower(F.concat_ws("\n", *fields)), F.lit(text.lower()))) if text else rows
    for column, value in wanted.items():
        values = ["approved", "modified"] if value == "accepted" else [value] if isinstance(value, str) else list(value)
        out = out.where(F.lower(column).isin(*[v.lower() for v in values]))
    return out


def same_ids(expected: DataFrame, received: DataFrame, key: str) -> DataFrame:
    """What keeps two sets of ids from being equal: ``key, problem`` (missing, unexpected, repeated); empty if they are."""
    one, two = expected.select(key).distinct().withColumn("_e", F.lit(True)), received.groupBy(key).agg(F.count("*").alias("_n"))
    problem = F.when(F.col("_n").isNull(), "missing").when(F.col("_e").isNull(), "unexpected").when(F.col("_n") > 1, "repeated")
    return one.join(two, key, "full").select(key, problem.alias("problem")).where("problem is not null")


def uniform_dimension(vectors: DataFrame, vector: str) -> DataFrame:
    """One row: ``n, least, most, uniform`` of the vectors' sizes."""
    size = F.size(vector)
    return vectors.agg(F.count("*").alias("n"), F.min(size).cast("long").alias("least"), F.max(size).cast("long").alias("most"), (F.min(size) == F.max(size)).alias("uniform"))


def bundle_id(rows: DataFrame, per_bucket: int = 4096) -> DataFrame:
    """One row with the fingerprint of a set of (``rule_id, hash``) rows, whatever their order.

    Rows are joined in order of id within buckets named by the hash's first hex digits, about ``per_bucket`` rows each; the buckets' digests
    are folded by two digits at a time, so no row ever holds more than a bucket or 256 digests.
    """
    n = rows.count()
    digits = 2
    while n > per_bucket * 16**digits:
        digits += 2
    parts = rows.groupBy(F.substring("hash", 1, digits).alias("b")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rule_id", "hash"))), lambda x: F.concat_ws(":", x["rule_id"].cast("string"), x["hash"])), "\n"), 256).alias("h"), F.count("*").alias("n"))
    joined = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "h"))), lambda x: x["h"]), "\n"), 256)
    while digits > 2:
        digits -= 2
        parts = parts.groupBy(F.substring("b", 1, digits).alias("p")).agg(joined.alias("h"), F.sum("n").alias("n")).withColumnRenamed("p", "b")
    return parts.agg(joined.alias("bundle_id"), F.coalesce(F.sum("n"), F.lit(0)).alias("rule_count"))


def cache_misses(keyed: DataFrame, cache: DataFrame) -> DataFrame:
    """Add ``cached`` to rows with a content ``key``: is it in the cache (``key``)?"""
    known = cache.select("key").distinct().withColumn("_hit", F.lit(True))
    return keyed.join(known, "key", "left").withColumn("cached", F.coalesce("_hit", F.lit(False))).drop("_hit")


def enriched(keyed: DataFrame, cache: DataFrame, provider: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], columns: str) -> DataFrame:
    """``key``, ``columns`` and ``cached`` for every distinct key: from the cache, or from ``provider``, which is asked once for each missing key.

    ``provider`` maps batches of the misses (``keyed``'s columns) to batches of ``key`` and ``columns``, a DDL string.
    """
    names = [c.split()[0] for c in columns.split(", ")]
    hits = keyed.select("key").distinct().join(cache.select("key", *names), "key").withColumn("cached", F.lit(True))
    missing = keyed.join(cache.select("key"), "key", "left_anti").dropDuplicates(["key"])
    made = missing.mapInPandas(provider, f"key string, {columns}").withColumn("cached", F.lit(False))
    return hits.select("key", *names, "cached").unionByName(made)


def mirror(current: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Upsert: incoming values win column by column where they aren't null; adds ``change`` (kept, updated or inserted)."""
    values = [c for c in current.columns if c != key]
    a = current.select(F.col(key), F.lit(True).alias("_a"), *[F.col(c).alias(f"_a_{c}") for c in values])
    b = incoming.select(F.col(key), F.lit(True).alias("_b"), *[F.col(c).alias(f"_b_{c}") for c in values])
    change = F.when(F.col("_b").isNull(), "kept").when(F.col("_a").isNull(), "inserted").otherwise("updated")
    return a.join(b, key, "full").select(key, *[F.coalesce(f"_b_{c}", f"_a_{c}").alias(c) for c in values], change.alias("change"))
