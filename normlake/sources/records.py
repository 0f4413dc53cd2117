"""Rules, events and bundles as JSON: explicit schemas, malformed lines skipped, approved rules exported."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SOURCE = "struct<document:string,section:string,line_start:int,line_end:int,quote:string>"
RULE = f"id string, title string, statement string, scope string, category string, severity string, status string, source {SOURCE}, enforcement_candidates array<string>, trigger_terms array<string>, tags array<string>, confidence double, reviewer_notes string"
RESULT = "struct<rule_id:string,checker:string,status:string,severity:string,message:string,path:string,line:int,evidence:string,source:string,blocking:boolean>"
EVENT = f"schema_version int, event_id string, timestamp string, session_id string, event string, path string, policy_status string, policy_version string, outcome string, matched_rule_ids array<string>, results array<{RESULT}>"


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """An append-only event log of JSON lines; malformed lines and those that aren't objects are skipped."""
    return spark.read.schema(EVENT).option("mode", "DROPMALFORMED").json(path).where("event_id is not null or event is not null")


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """A bundle file, ``{"rules": [...]}``, or a bare list of rules, as one row per rule; confidence is held to 0 to 1."""
    fields = ",".join(f"{p.split(' ', 1)[0]}:{p.split(' ', 1)[1]}" for p in RULE.split(", "))
    whole = spark.read.schema(f"rules array<struct<{fields}>>, policy_version string, bundle_id string, {RULE}").json(path, multiLine=True)
    names = [p.split(" ", 1)[0] for p in RULE.split(", ")]
    nested = whole.where("rules is not null").select(F.explode("rules").alias("r"), "policy_version", "bundle_id").select("r.*", "policy_version", "bundle_id")
    rows = nested.unionByName(whole.where("rules is null and id is not null").select(*names, "policy_version", "bundle_id"))
    return rows.withColumn("confidence", F.least(F.lit(1.0), F.greatest(F.lit(0.0), "confidence")))


def write_approved(rules: DataFrame, path: str) -> None:
    """Export the approved rules; an existing export is replaced when the new one is complete."""
    rules.where("status = 'approved'").write.mode("overwrite").json(path)


def validate_bundle(rules: DataFrame) -> list[str]:
    """What is wrong with a bundle: it is empty, holds a rule that isn't approved, ids that repeat, or several or no proper bundle ids. One pass."""
    proper = F.coalesce(F.lower("bundle_id").rlike("^[0-9a-f]{64}$"), F.lit(False)) if "bundle_id" in rules.columns else F.lit(True)
    bundles = F.count_distinct("bundle_id") if "bundle_id" in rules.columns else F.lit(1)
    row = rules.agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.col("status") != "approved", F.lit(True))).alias("open"), F.count_distinct("id").alias("ids"), F.count_if(~proper).alias("improper"), F.max(F.lit(1)).alias("_"), bundles.alias("bundles")).first()
    found = [("empty bundle", row["n"] == 0), ("rules that aren't approved", row["open"] > 0), ("ids that repeat", row["ids"] < row["n"]), ("a bundle id that isn't 64 hexadecimal digits", row["improper"] > 0), ("several bundle ids", row["bundles"] > 1)]
    return [what for what, wrong in found if wrong]
