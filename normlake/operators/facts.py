"""Session facts: partial summaries of an event log that merge, and the summaries and reports that follow from them.

A fact is a row ``session_id, kind, rule_id, path, checker`` with measures that merge whatever the order: a count, whether it ever failed, and what the
last event said of it. Facts of two parts of a log are unioned and grouped again, so what is stored of the past never has to be
read event by event, and a session with a large part of the log is aggregated before it is shuffled.

Null and missing texts are empty, a missing event name is ``unknown``, a result without a rule belongs to ``UNKNOWN-RULE``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.payloads import cell, safe_session, trimmed
from .audit import FAILED, SETTLED

KEYS = ["session_id", "kind", "rule_id", "path", "checker"]
SCHEMA = "session_id string, kind string, rule_id string, path string, checker string, n long, failed boolean, at struct<timestamp:string,event_id:string,pos:int>, last struct<status:string,severity:string,message:string,blocking:boolean,policy:string>"
#: Events whose path is a changed file, and those that ask for reviews or clear them.
WRITES = ("post_write_check", "write_observed", "pre_write_authorized")
ATTESTED = "ai_review_self_attested"


def _text(c: Column | str) -> Column:
    return trimmed(F.col(c) if isinstance(c, str) else c)


def facts(events: DataFrame) -> DataFrame:
    """The facts (``SCHEMA``) of events of ``sources.records.EVENT``; each event's are made in one pass."""
    name = F.when(_text("event") == "", "unknown").otherwise(_text("event"))
    none = F.lit("")

    def fact(kind: str, rule: Column = none, path: Column = none, checker: Column = none, failed: Column = F.lit(False), pos: Column = F.lit(0), status: Column = none, severity: Column = none, message: Column = none, blocking: Column = F.lit(False), policy: Column = none) -> Column:
        return F.struct(F.lit(kind).alias("kind"), rule.alias("rule_id"), path.alias("path"), checker.alias("checker"), failed.alias("failed"), pos.cast("int").alias("pos"), F.struct(status.alias("status"), severity.alias("severity"), message.alias("message"), blocking.alias("blocking"), policy.alias("policy")).alias("last"))

    def each(values: Column, make) -> Column:  # noqa: ANN001
        return F.coalesce(F.transform(values, make), F.array())

    def result_of(r: Column, i: Column) -> Column:
        rule = F.when(_text(r["rule_id"]) == "", "UNKNOWN-RULE").otherwise(_text(r["rule_id"]))
        status = F.coalesce(r["status"], F.lit("unknown"))
        bad = status.isin(*FAILED)
        stops = bad & F.coalesce(r["blocking"], F.lit(False))
        asks = (status == "review") & ((name == "post_write_check") | ((name == "stop_summary") & (_text("outcome") != "completed")))
        said = {"pos": i, "status": status, "severity": F.coalesce(r["severity"], none), "message": F.coalesce(r["message"], none), "blocking": F.coalesce(r["blocking"], F.lit(False))}
        own = [fact("result", rule, _text(r["path"]), _text(r["checker"]), bad, **said)]
        own += [F.when(_text(r["rule_id"]) != "", fact("rule", _text(r["rule_id"]))), F.when(bad & (_text(r["rule_id"]) != ""), fact("failed", _text(r["rule_id"])))]
        own += [F.when(stops, fact("blocking")), F.when(asks, fact("review", rule, _text(r["path"]), **said))]
        return F.array_compact(F.array(*own))

    results = F.col("results")
    bad, asked = (F.size(F.filter(results, lambda r: r["status"].isin(*s))) for s in (FAILED, ("review",)))
    tally = F.when((bad > 0) | (asked > 0), F.concat(F.lit("failed "), bad.cast("string"), F.lit(", to review "), asked.cast("string"))).otherwise("passed")
    outcome = F.when(F.coalesce(F.size(results), F.lit(0)) > 0, tally).otherwise(_text("outcome"))
    head = [fact("event", checker=name), F.when(_text("policy_status") != "", fact("policy", checker=_text("policy_status"))), F.when(name.isin(*WRITES) & (_text("path") != ""), fact("file", path=_text("path")))]
    # An event's own line is kept under its id.
    head.append(fact("line", checker=F.coalesce("event_id", none), path=_text("path"), status=name, message=outcome, policy=_text("policy_status")))
    matched = F.filter("matched_rule_ids", lambda x: _text(x) != "")
    all_of = F.concat(F.array_compact(F.array(*head)), each(matched, lambda x: fact("rule", _text(x))), F.when(name == ATTESTED, each(matched, lambda x: fact("attested", _text(x)))).otherwise(F.array()), F.flatten(F.coalesce(F.transform(results, result_of), F.array())))
    rows = events.select(F.col("session_id").cast("string").alias("session_id"), F.coalesce("timestamp", none).alias("timestamp"), F.coalesce("event_id", none).alias("event_id"), F.explode(all_of).alias("f"))
    return merge(rows.select("session_id", "f.kind", "f.rule_id", "f.path", "f.checker", F.lit(1).cast("long").alias("n"), "f.failed", F.struct("timestamp", "event_id", "f.pos").alias("at"), "f.last"))


def merge(rows: DataFrame) -> DataFrame:
    """Facts of several parts of a log as those of the whole."""
    return rows.groupBy(*KEYS).agg(F.sum("n").alias("n"), F.bool_or("failed").alias("failed"), F.max("at").alias("at"), F.max_by("last", "at").alias("last"))


def open_reviews(merged: DataFrame) -> DataFrame:
    """The ``review`` facts that no later event of their session has attested."""
    cleared = merged.where("kind = 'attested'").select(F.col("session_id").alias("_s"), F.col("rule_id").alias("_r"), F.col("at").alias("_cleared"))
    asked = merged.where("kind = 'review'")
    return asked.join(cleared, F.col("session_id").eqNullSafe(F.col("_s")) & (F.col("rule_id") == F.col("_r")) & (F.col("at") < F.col("_cleared")), "left_anti")


def states(merged: DataFrame) -> DataFrame:
    """The ``result`` facts that are unresolved, or failed once and are settled now (``state``)."""
    state = F.when(F.col("last.status").isin(*FAILED), "unresolved").when(F.col("failed") & F.col("last.status").isin(*SETTLED), "resolved")
    return merged.where("kind = 'result'").withColumn("state", state).where("state is not null")


def summary(merged: DataFrame) -> DataFrame:
    """One row for each session: numbers of events, files, rules, failed rules and blocking failures, open and settled issues, reviews to come and attested rules."""
    kinds = {"events": ("event", True), "changed_files": ("file", False), "matched_rules": ("rule", False), "failed_rules": ("failed", False), "blocking_failures": ("blocking", True), "attested_rules": ("attested", False)}
    counted = [F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n") if total else F.lit(1))), F.lit(0)).cast("long").alias(c) for c, (k, total) in kinds.items()]
    heads = merged.groupBy("session_id").agg(*counted)
    issues = states(merged).groupBy("session_id").agg(F.count_if(F.col("state") == "unresolved").alias("unresolved"), F.count_if(F.col("state") == "resolved").alias("resolved"))
    waiting = open_reviews(merged).groupBy("session_id").agg(F.count("*").alias("pending_reviews"))
    out = heads
    for part in (issues, waiting):
        names = [c for c in part.columns if c != "session_id"]
        part = part.withColumnRenamed("session_id", "_s")
        out = out.join(part, F.col("session_id").eqNullSafe(F.col("_s")), "left").drop("_s").na.fill(0, names)
    return out


#: A report's sections in order: its heading, and the kind of fact that each of its lines shows.
SECTIONS = (("Policy lookups", "policy"), ("Changed files", "file"), ("Rules", "rule"), ("Unresolved", "unresolved"), ("Resolved", "resolved"), ("Reviews to come", "review"), ("Attested by the author", "attested"), ("Timeline", "line"))


def report_lines(merged: DataFrame) -> DataFrame:
    """``session_id, section, place, line``: the Markdown report of each session, to be read by section and place.

    Lines stay rows, so a session's report may be of any length. Section 0 is the head with the session's state; a section without facts says so.
    """
    short = summary(merged)
    state = (
        F.when(F.col("unresolved") > 0, F.concat(F.col("unresolved").cast("string"), F.lit(" unresolved"))).when(F.col("pending_reviews") > 0, F.concat(F.col("pending_reviews").cast("string"), F.lit(" reviews to come")))
        .when(F.col("resolved") > 0, "all failures resolved").when(F.col("blocking_failures") > 0, "failures blocked, none is left").otherwise("nothing unresolved")
    )
    head = F.array(F.concat(F.lit("# Session "), safe_session(F.col("session_id"))), F.concat(F.lit("- State: "), state), *[F.concat(F.lit(f"- {label}: "), F.col(c).cast("string")) for label, c in (("Events", "events"), ("Files", "changed_files"), ("Rules", "matched_rules"), ("Blocking failures", "blocking_failures"))])
    top = short.select("session_id", F.lit(0).alias("section"), F.posexplode(head).alias("p", "line")).select("session_id", "section", F.lpad(F.col("p").cast("string"), 3, "0").alias("place"), "line")
    heading = F.explode(F.array(*[F.struct(F.lit(i).alias("section"), F.lit(f"## {title}").alias("line")) for i, (title, _) in enumerate(SECTIONS, 1)])).alias("x")
    headings = short.select("session_id", heading).select("session_id", "x.section", F.lit("").alias("place"), "x.line")
    numbers = {kind: i for i, (_, kind) in enumerate(SECTIONS, 1)}
    spot = F.concat_ws(" / ", cell(F.col("rule_id")), cell(F.col("path")), cell(F.col("checker")))
    shown = {
        "policy": F.concat(F.lit("- "), cell(F.col("checker")), F.lit(": "), F.col("n").cast("string")), "file": F.concat(F.lit("- "), cell(F.col("path"))), "rule": F.concat(F.lit("- "), cell(F.col("rule_id"))), "attested": F.concat(F.lit("- "), cell(F.col("rule_id"))),
        "line": F.concat(F.lit("| "), F.concat_ws(" | ", cell(F.col("at.timestamp"), 32), cell(F.col("last.status"), 50), cell(F.col("path")), cell(F.col("last.policy"), 50), cell(F.col("last.message"))), F.lit(" |")),
    }
    by = lambda table: F.coalesce(*[F.when(F.col("kind") == k, v) for k, v in table.items()])
    place = F.when(F.col("kind") == "line", F.concat_ws(" ", "at.timestamp", "at.event_id")).otherwise(F.concat_ws(" ", F.lit("-"), "rule_id", "path", "checker"))
    plain = merged.where(F.col("kind").isin(*shown)).select("session_id", by({k: F.lit(numbers[k]) for k in shown}).alias("section"), place.alias("place"), by(shown).alias("line"))
    said = F.concat(F.lit("- "), spot, F.lit(": "), cell(F.col("last.message")))
    issues = states(merged).select("session_id", F.when(F.col("state") == "unresolved", numbers["unresolved"]).otherwise(numbers["resolved"]).alias("section"), F.concat_ws(" ", F.lit("-"), "rule_id", "path", "checker").alias("place"), F.when(F.col("state") == "unresolved", said).otherwise(F.concat(F.lit("- "), spot)).alias("line"))
    waiting = open_reviews(merged).select("session_id", F.lit(numbers["review"]).alias("section"), F.concat_ws(" ", F.lit("-"), "rule_id", "path").alias("place"), F.concat(F.lit("- "), cell(F.col("rule_id")), F.lit(" / "), cell(F.col("path"))).alias("line"))
    return top.unionByName(headings).unionByName(plain).unionByName(issues).unionByName(waiting)
