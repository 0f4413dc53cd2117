"""Registered report queries: the event log as sessions of checks, summarised as it comes and reported line by line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import shared_path
from ..operators import facts as f
from ..streaming import summaries

_NAMES = {"error": "post_write_check", "purchase": "ai_review_self_attested", "view": "pre_write_authorized", "click": "stop_summary"}


def session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of ``sources.records.EVENT``: errors and clicks hold two results each, purchases attest, a third has no policy status, sign-ups have no name."""
    k, e = F.get_json_object("props", "$.k").cast("int"), F.col("event_id")
    name = F.coalesce(*[F.when(F.col("event_type") == a, b) for a, b in _NAMES.items()])
    path = F.when(F.col("event_type") != "purchase", F.concat(F.lit("f|"), (k % 7).cast("string")))
    status = F.when(e % 4 == 0, "fail").when(e % 4 == 1, "pass").when(e % 4 == 2, "review").otherwise("error")

    def result(rule: F.Column, status: F.Column, checker: str) -> F.Column:
        return F.struct(rule.alias("rule_id"), F.lit(checker).alias("checker"), status.alias("status"), F.lit("major").alias("severity"), F.concat(F.lit("m "), e.cast("string")).alias("message"), path.alias("path"), F.lit(1).alias("line"), F.lit("").alias("evidence"), F.lit("").alias("source"), (F.col("value") > 5).alias("blocking"))

    results = F.array(result(F.concat(F.lit("R"), (k % 5).cast("string")), status, "a"), result(F.when(k % 6 > 0, F.concat(F.lit("R"), (k % 3).cast("string"))), F.when(k % 4 == 0, "review").otherwise("skip"), "b"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("user_id").cast("string").alias("session_id"), F.lpad(e.cast("string"), 12, "0").alias("event_id"), F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss").alias("timestamp"), name.alias("event"), path.alias("path"),
        F.when(k % 3 == 0, "matched").when(k % 3 == 1, "none").alias("policy_status"), F.when(k % 2 == 0, "completed").otherwise(" blocked").alias("outcome"), F.array(F.concat(F.lit("R"), (k % 5).cast("string"))).alias("matched_rule_ids"), F.when(F.col("event_type").isin("error", "click"), results).alias("results"),
    )


def merged_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries kept up to date over five micro-batches of the log, their facts merged two by two."""
    out = shared_path(spark, "summaries")
    session_events(spark, sf_dir).repartitionByRange(5, "timestamp", "event_id").write.parquet(f"{out}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{out}/in").schema).option("maxFilesPerTrigger", 1).parquet(f"{out}/in")
    summaries.summaries_as_they_come(stream, f"{out}/kept", f"{out}/state", fan=2, buckets=4, reports=False).awaitTermination()
    return summaries.latest(spark, f"{out}/kept")


def session_report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every session's Markdown report, timeline and tallies included, as lines."""
    return f.report_lines(f.facts(session_events(spark, sf_dir)))


QUERIES = {q.__name__: q for q in (merged_summaries, session_report_lines)}
_LOG = """e AS (SELECT user_id::varchar AS s, lpad(event_id::varchar, 12, '0') AS id, event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS t, event_type, (props->>'$.k')::int AS k, value > 5 AS stops,
      CASE event_type WHEN 'error' THEN 'post_write_check' WHEN 'purchase' THEN 'ai_review_self_attested' WHEN 'view' THEN 'pre_write_authorized' WHEN 'click' THEN 'stop_summary' ELSE 'unknown' END AS name FROM events),
    x AS (SELECT *, CASE WHEN event_type <> 'purchase' THEN 'f|' || k % 7 ELSE '' END AS path, CASE k % 3 WHEN 0 THEN 'matched' WHEN 1 THEN 'none' ELSE '' END AS policy, CASE WHEN k % 2 = 0 THEN 'completed' ELSE 'blocked' END AS outcome, 'R' || k % 5 AS rule FROM e),
    c AS (SELECT * FROM x WHERE event_type IN ('error', 'click')),
    q AS (SELECT s, t, id, 0 AS pos, name, outcome, path, stops, rule AS given, 'a' AS checker, CASE event_id % 4 WHEN 0 THEN 'fail' WHEN 1 THEN 'pass' WHEN 2 THEN 'review' ELSE 'error' END AS status, 'm ' || event_id AS message FROM c
      UNION ALL SELECT s, t, id, 1, name, outcome, path, stops, CASE WHEN k % 6 > 0 THEN 'R' || k % 3 ELSE '' END, 'b', CASE WHEN k % 4 = 0 THEN 'review' ELSE 'skip' END, 'm ' || event_id FROM c),
    r AS (SELECT *, CASE WHEN given = '' THEN 'UNKNOWN-RULE' ELSE given END AS rule, status IN ('fail', 'error') AS bad FROM q),
    l AS (SELECT s, rule, path, checker, arg_max(status, (t, id, pos)) AS status, arg_max(message, (t, id, pos)) AS message, bool_or(bad) AS failed FROM r GROUP BY ALL),
    st AS (SELECT *, CASE WHEN status IN ('fail', 'error') THEN 'unresolved' WHEN failed AND status IN ('pass', 'skip') THEN 'resolved' END AS state FROM l),
    a AS (SELECT s, rule, max((t, id)) AS moment FROM x WHERE event_type = 'purchase' GROUP BY s, rule),
    v AS (SELECT s, rule, path, max((t, id)) AS moment FROM r WHERE status = 'review' AND (name = 'post_write_check' OR name = 'stop_summary' AND outcome <> 'completed') GROUP BY s, rule, path),
    w AS (SELECT v.* FROM v LEFT JOIN a USING (s, rule) WHERE a.moment IS NULL OR v.moment >= a.moment),
    m AS (SELECT s, rule FROM x UNION SELECT s, given FROM r WHERE given <> ''),
    z AS (SELECT s, count(*) AS events FROM x GROUP BY s),
    o AS (SELECT z.s AS session_id, events, coalesce(fi.n, 0) AS changed_files, coalesce(ru.n, 0) AS matched_rules, coalesce(fa.n, 0) AS failed_rules, coalesce(fa.b, 0)::bigint AS blocking_failures, coalesce(ta.n, 0) AS attested_rules, coalesce(i.u, 0) AS unresolved, coalesce(i.r, 0) AS resolved, coalesce(p.n, 0) AS pending_reviews
      FROM z LEFT JOIN (SELECT s, count(DISTINCT path) AS n FROM x WHERE name IN ('post_write_check', 'pre_write_authorized') GROUP BY s) fi USING (s) LEFT JOIN (SELECT s, count(*) AS n FROM m GROUP BY s) ru USING (s)
      LEFT JOIN (SELECT s, count(DISTINCT given) FILTER (bad AND given <> '') AS n, count(*) FILTER (bad AND stops) AS b FROM r GROUP BY s) fa USING (s) LEFT JOIN (SELECT s, count(*) AS n FROM a GROUP BY s) ta USING (s)
      LEFT JOIN (SELECT s, count(*) FILTER (state = 'unresolved') AS u, count(*) FILTER (state = 'resolved') AS r FROM st GROUP BY s) i USING (s) LEFT JOIN (SELECT s, count(*) AS n FROM w GROUP BY s) p USING (s))"""
_CELL = "replace({0}, '|', '\\|')"
ORACLES = {
    "merged_summaries": f"WITH {_LOG} SELECT * FROM o",
    "session_report_lines": f"""WITH {_LOG}, h AS (SELECT session_id, [
        '# Session ' || session_id, '- State: ' || CASE WHEN unresolved > 0 THEN unresolved || ' unresolved' WHEN pending_reviews > 0 THEN pending_reviews || ' reviews to come' WHEN resolved > 0 THEN 'all failures resolved' WHEN blocking_failures > 0 THEN 'failures blocked, none is left' ELSE 'nothing unresolved' END,
        '- Events: ' || events, '- Files: ' || changed_files, '- Rules: ' || matched_rules, '- Blocking failures: ' || blocking_failures] AS lines FROM o),
      n AS (SELECT s, t, id, count(*) FILTER (bad) AS f, count(*) FILTER (status = 'review') AS v FROM r GROUP BY s, t, id)
      SELECT session_id, 0 AS section, lpad(i::varchar, 3, '0') AS place, lines[i + 1] AS line FROM h, range(6) AS g(i)
      UNION ALL SELECT session_id, i, '', '## ' || ['Policy lookups', 'Changed files', 'Rules', 'Unresolved', 'Resolved', 'Reviews to come', 'Attested by the author', 'Timeline'][i] FROM o, range(1, 9) AS g(i)
      UNION ALL SELECT s, 1, '-   ' || policy, '- ' || policy || ': ' || count(*) FROM x WHERE policy <> '' GROUP BY s, policy
      UNION ALL SELECT DISTINCT s, 2, '-  ' || path || ' ', '- ' || {_CELL.format('path')} FROM x WHERE name IN ('post_write_check', 'pre_write_authorized')
      UNION ALL SELECT s, 3, '- ' || rule || '  ', '- ' || rule FROM m
      UNION ALL SELECT s, CASE state WHEN 'unresolved' THEN 4 ELSE 5 END, '- ' || rule || ' ' || path || ' ' || checker, '- ' || rule || ' / ' || {_CELL.format('path')} || ' / ' || checker || CASE WHEN state = 'unresolved' THEN ': ' || message ELSE '' END FROM st WHERE state IS NOT NULL
      UNION ALL SELECT s, 6, '- ' || rule || ' ' || path, '- ' || rule || ' / ' || {_CELL.format('path')} FROM w
      UNION ALL SELECT s, 7, '- ' || rule || '  ', '- ' || rule FROM a
      UNION ALL SELECT x.s, 8, x.t || ' ' || x.id, '| ' || concat_ws(' | ', x.t, name, CASE WHEN path = '' THEN '—' ELSE {_CELL.format('path')} END, CASE WHEN policy = '' THEN '—' ELSE policy END, CASE WHEN n.id IS NULL THEN outcome WHEN f + v > 0 THEN 'failed ' || f || ', to review ' || v ELSE 'passed' END) || ' |' FROM x LEFT JOIN n ON n.s = x.s AND n.t = x.t AND n.id = x.id""",
}
