"""Registered session queries: edits, report rows, the write gate's predicates and the receipt stream's batch twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import payloads as t
from ..functions.edits import apply_edits
from ..operators import gates, receipts
from .streams import GATE_SQL, TTL, gate_events


def _talks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


def apply_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    edits = F.array(F.struct(F.lit("the").alias("old"), F.lit("THE").alias("new"), F.lit(True).alias("every")), F.struct(F.lit("THE").alias("old"), F.lit("<1>").alias("new"), F.lit(False).alias("every")), F.struct(F.lit("absent!").alias("old"), F.lit("x").alias("new"), F.lit(True).alias("every")))
    return _talks(spark, sf_dir).select("conv_id", "turn", F.sha2(apply_edits(F.col("text"), edits), 256).alias("edited_sha256"))


def receipt_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The receipt fold over a whole log: a purchase prepares, an error edits; an edit consumes the receipt before it."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type in ('purchase', 'error')")
    # The receipt in force is the event just before, if that is a purchase: an edit in between would have consumed it.
    asked = gates.before_in_session(events, "user_id", ["ts", "event_id"], F.struct("event_type", "ts"), "before")
    age = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("before.ts").cast("timestamp"))) / 1e6
    authorized = (F.col("before.event_type") == "purchase") & (age >= 0) & (age <= 36_000)
    return asked.where("event_type = 'error'").select("user_id", "event_id", F.coalesce(authorized, F.lit(False)).alias("authorized"))


def edit_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate before and after writes, by session and path, over the whole log at once."""
    return receipts.decisions(gate_events(spark, sf_dir), TTL)


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as tool calls in JSON: the tool, its path or command, and the session follow the page's number and address."""
    k = F.col("page_id")
    path = F.concat(F.regexp_replace("url", r"^https?://[^/]+/", ""), F.when(k % 4 == 0, ".java").when(k % 4 == 1, ".md").when(k % 4 == 2, ".YML").otherwise(""))
    tool = F.when(k % 5 == 0, " Write ").when(k % 5 == 1, "bash").when(k % 5 == 2, "PowerShell").when(k % 5 == 3, "read")
    command = F.when(k % 7 == 0, F.concat(F.lit("cat x > "), path)).when(k % 7 == 1, F.concat(F.lit("sed -i s/a/b/ "), path)).when(k % 7 == 2, F.concat(F.lit("grep a "), path)).when(k % 7 == 3, F.concat(F.lit("git checkout "), path)).when(k % 7 == 4, F.concat(F.lit("open('"), path, F.lit("').write(1)")))
    given = F.struct(F.when(k % 3 == 0, path).alias("file_path"), F.when(k % 3 == 1, path).alias("path"), command.alias("command"))
    body = F.struct(
        F.when(k % 2 == 0, tool).alias("tool_name"), F.when(k % 2 == 1, tool).alias("toolName"), given.alias("tool_input"), F.lit("/w/").alias("cwd"), F.when(k % 4 == 0, F.concat(F.lit(" s "), F.col("url"))).alias("session_id"), F.when(k % 4 == 1, F.col("url")).alias("transcriptPath"),
        F.when(k % 6 == 0, "No").when(k % 6 == 1, "yes").alias("is_error"), F.when(k % 3 == 0, "Pre_Tool_Use").when(k % 3 == 1, "STOP").otherwise("other_one").alias("hook"),
    )
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.to_json(body).alias("payload"))


def tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a gate reads from each call: event, tool, target, session, whether it failed, writes a managed file, or is a shell command that would."""
    p = F.col("payload")
    return _calls(spark, sf_dir).select("page_id", t.event_name(F.get_json_object(p, "$.hook")).alias("event"), t.tool_name(p).alias("tool"), t.target_path(p).alias("target"), t.session_id(p, F.lit(7)).alias("session"), t.tool_failed(p).alias("failed"), t.managed_write(p).alias("managed"), t.shell_write(p).alias("shell_write"))


def managed_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many calls of each tool write managed files by an edit tool, or would by a shell command."""
    p = F.col("payload")
    return _calls(spark, sf_dir).groupBy(t.tool_name(p).alias("tool")).agg(F.count("*").alias("n"), F.count_if(t.managed_write(p)).alias("managed"), F.count_if(t.shell_write(p)).alias("denied"))


def report_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of a Markdown report: pipes escaped, white space single, cut to 60 characters."""
    return _talks(spark, sf_dir).select(t.safe_session(F.concat_ws("/", "role", "conv_id")).alias("session"), "turn", t.cell(F.col("text"), 60).alias("cell"))


def stop_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """May each conversation end? Its turns are results (by turn), and its own lines the evidence for reviews of roles."""
    talks = _talks(spark, sf_dir)
    status = F.when(F.col("turn") % 4 == 0, "review").when((F.col("turn") % 4 == 1) & (F.col("conv_id") % 3 == 0), "fail").when((F.col("turn") % 4 == 2) & (F.col("conv_id") % 5 == 0), "error").otherwise("pass")
    results = talks.select(F.col("conv_id").alias("session_id"), F.col("role").alias("rule_id"), status.alias("status"), (F.col("conv_id") % 2 == 0).alias("blocking"))
    proof = talks.where("turn > 0").select(F.col("conv_id").alias("session_id"), F.col("role").alias("rule_id"), F.col("text").rlike("(?i) (the|la|der) ").alias("valid"))
    return gates.stop_gate(results, proof)


def merged_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards of three origins for each user, each product once: those of errors, then of purchases, then of views."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("query_id"), F.get_json_object("props", "$.k").alias("id"), F.col("event_id").alias("at"), "event_type").where("id is not null")
    kinds = [events.where(F.col("event_type") == k).groupBy("query_id", "id").agg(F.min("at").alias("at")) for k in ("error", "purchase", "view")]
    return gates.merge_cards(*kinds, 5)


def review_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One hash for each conversation's turns as reviews, whatever their order."""
    turns = F.collect_list(F.struct(F.col("role").alias("rule_id"), F.col("turn").cast("string").alias("path"), F.col("text").alias("content")))
    return _talks(spark, sf_dir).groupBy("conv_id").agg(t.review_signature(turns).alias("signature"))


def permissive_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first word of each turn as a flag that people wrote, and both as canonical JSON."""
    word = F.element_at(F.split("text", " "), 1)
    value = F.when(F.length(word) % 3 == 0, F.lit(" No ")).when(F.length(word) % 3 == 1, word)
    return _talks(spark, sf_dir).select("conv_id", "turn", t.permissive_bool(value).alias("flag"), t.permissive_bool(value, True).alias("flag_or_true"), t.canonical({"b": F.col("turn"), "a": value}).alias("json"))


QUERIES = {f.__name__: f for f in (apply_edit, receipt_decisions, managed_writes, report_cells, edit_gate, tool_calls, stop_gate, merged_cards, review_signatures, permissive_flags)}
_FLAT = "replace(trim(regexp_replace(text, '\\s+', ' ', 'g'), ' '), '|', '\\|')"
_REST = "replace(text, 'the', 'THE')"
_EXT = "(?:\\.java|\\.xml|\\.yml|\\.yaml|\\.properties)"
_CALLS = f"""a AS (SELECT page_id, page_id AS k, url, regexp_replace(url, '^https?://[^/]+/', '') || CASE page_id % 4 WHEN 0 THEN '.java' WHEN 1 THEN '.md' WHEN 2 THEN '.YML' ELSE '' END AS path FROM pages),
  b AS (SELECT *, CASE k % 5 WHEN 0 THEN 'write' WHEN 1 THEN 'bash' WHEN 2 THEN 'powershell' WHEN 3 THEN 'read' ELSE '' END AS tool, lower(CASE k % 7 WHEN 0 THEN 'cat x > ' || path WHEN 1 THEN 'sed -i s/a/b/ ' || path WHEN 2 THEN 'grep a ' || path WHEN 3 THEN 'git checkout ' || path WHEN 4 THEN 'open(' || chr(39) || path || chr(39) || ').write(1)' ELSE '' END) AS command,
    CASE WHEN k % 3 < 2 THEN '/w/' || path ELSE '' END AS target FROM a),
  m AS (SELECT page_id, CASE k % 3 WHEN 0 THEN 'pre-edit' WHEN 1 THEN 'stop' ELSE 'other-one' END AS event, tool, target,
    CASE k % 4 WHEN 0 THEN substr(regexp_replace(regexp_replace('s ' || url, '[^A-Za-z0-9_.-]+', '-', 'g'), '^[.-]+|[.-]+$', '', 'g'), 1, 120) WHEN 1 THEN 'session-' || substr(sha256(url), 1, 16) ELSE 'session-' || substr(sha256('/w/|7'), 1, 16) END AS session, k % 6 = 1 AS failed,
    tool IN ('', 'write') AND regexp_matches(lower(target), '[^/]{_EXT}$') AS managed,
    tool IN ('bash', 'powershell') AND regexp_matches(command, '{_EXT}') AND (regexp_matches(command, '>\\s*[^\\s"]*{_EXT}(\\s|$)') OR regexp_matches(command, '(?:^|[\\s;&|])sed\\s+-i(?:\\s|$)') OR contains(command, '.write(') OR regexp_matches(command, '(?:^|\\s)git\\s+checkout\\b')) AS shell_write FROM b)"""
ORACLES = {
    "apply_edit": f"SELECT conv_id, turn, sha256(CASE WHEN contains({_REST}, 'THE') THEN substr({_REST}, 1, instr({_REST}, 'THE') - 1) || '<1>' || substr({_REST}, instr({_REST}, 'THE') + 3) ELSE text END) AS edited_sha256 FROM conversations",
    "receipt_decisions": """SELECT user_id, event_id, coalesce(before = 'purchase' AND epoch(ts) - epoch(since) BETWEEN 0 AND 36000, false) AS authorized FROM (
      SELECT *, lag(event_type) OVER w AS before, lag(ts) OVER w AS since FROM events WHERE event_type IN ('purchase', 'error') WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE event_type = 'error'""",
    "edit_gate": f"WITH RECURSIVE {GATE_SQL} SELECT s AS session_id, p AS path, id AS event_id, kind, decision FROM r WHERE decision <> ''",
    "managed_writes": f"WITH {_CALLS} SELECT tool, count(*) AS n, count(*) FILTER (managed) AS managed, count(*) FILTER (shell_write) AS denied FROM m GROUP BY tool",
    "tool_calls": f"WITH {_CALLS} SELECT page_id, event, tool, target, session, failed, managed, shell_write FROM m",
    "report_cells": f"SELECT substr(regexp_replace(role || '/' || conv_id, '[^A-Za-z0-9_.\\-]+', '-', 'g'), 1, 120) AS session, turn, CASE WHEN length({_FLAT}) > 60 THEN substr({_FLAT}, 1, 59) || '…' WHEN {_FLAT} = '' THEN '—' ELSE {_FLAT} END AS cell FROM conversations",
    "stop_gate": """WITH r AS (SELECT conv_id, role, CASE WHEN turn % 4 = 0 THEN 'review' WHEN turn % 4 = 1 AND conv_id % 3 = 0 THEN 'fail' WHEN turn % 4 = 2 AND conv_id % 5 = 0 THEN 'error' ELSE 'pass' END AS status FROM conversations),
      v AS (SELECT conv_id, role, bool_or(regexp_matches(text, '(?i) (the|la|der) ')) AS valid FROM conversations WHERE turn > 0 GROUP BY conv_id, role),
      q AS (SELECT conv_id, count(*) AS reviews, count(*) FILTER (NOT coalesce(valid, false)) AS unproven FROM (SELECT DISTINCT conv_id, role FROM r WHERE status = 'review') LEFT JOIN v USING (conv_id, role) GROUP BY conv_id),
      b AS (SELECT conv_id, count(*) FILTER (status = 'error' OR status = 'fail' AND conv_id % 2 = 0) AS blocking FROM r GROUP BY conv_id)
      SELECT conv_id AS session_id, CASE WHEN blocking > 0 THEN 'blocked' WHEN coalesce(unproven, 0) > 0 THEN 'review_required' ELSE 'completed' END AS outcome, blocking, coalesce(reviews, 0) AS reviews, coalesce(unproven, 0) AS unproven FROM b LEFT JOIN q USING (conv_id)""",
    "merged_cards": """WITH e AS (SELECT user_id AS query_id, json_extract_string(props, '$.k') AS id, CASE event_type WHEN 'error' THEN 0 WHEN 'purchase' THEN 1 ELSE 2 END AS kind, min(event_id) AS place0 FROM events WHERE event_type IN ('error', 'purchase', 'view') AND json_extract_string(props, '$.k') IS NOT NULL GROUP BY ALL),
      f AS (SELECT query_id, id, min((kind, place0)) AS m FROM e GROUP BY query_id, id), p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY m, id) AS place FROM f)
      SELECT query_id, id, ['direct', 'prepared', 'ranked'][m[1] + 1] AS origin, place FROM p WHERE m[1] = 0 OR place <= 5""",
    "review_signatures": "SELECT conv_id, sha256(string_agg(x, chr(31) ORDER BY x)) AS signature FROM (SELECT conv_id, role || ':' || turn || ':' || sha256(coalesce(text, '')) AS x FROM conversations) GROUP BY conv_id",
    "permissive_flags": """SELECT conv_id, turn, coalesce(lower(trim(v, ' ')) NOT IN ('', '0', 'false', 'no', 'off', 'none'), false) AS flag, coalesce(lower(trim(v, ' ')) NOT IN ('', '0', 'false', 'no', 'off', 'none'), true) AS flag_or_true, json_object('a', v, 'b', turn)::varchar AS json
      FROM (SELECT *, CASE WHEN length(w) % 3 = 0 THEN ' No ' WHEN length(w) % 3 = 1 THEN w END AS v FROM (SELECT *, string_split(text, ' ')[1] AS w FROM conversations))""",
}
