"""Registered event-log queries: user is the session, event type the key and status, odd values the paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit as a

POSITIVE, NEGATIVE = r"\b(the|la|der)\b", r"\b(and|et|und)\b"
NOW, TTL = "2024-01-15 00:00:00", 86_400 * 10


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """error is a failure, purchase a pass, view a skip, the others reviews; the key is user and k modulo 5."""
    status = F.when(F.col("event_type") == "error", "fail").when(F.col("event_type") == "purchase", "pass").when(F.col("event_type") == "view", "skip").otherwise("review")
    k = F.get_json_object("props", "$.k").cast("int") % 5
    return _events(spark, sf_dir).select("user_id", k.alias("checker"), status.alias("status"), "ts", "event_id")


def event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.event_counts(_events(spark, sf_dir), "event_type", "user_id")


def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by the status they carry; half of them have none."""
    status = F.when(F.col("event_id") % 4 == 0, F.lit(None)).when(F.col("event_id") % 4 == 1, "").otherwise(F.col("event_type"))
    return a.status_counts(_events(spark, sf_dir).withColumn("status", status), "status")


def review_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results that ask for a review, and the tallies of failures and reviews, by user."""
    event = F.when(F.col("event_id") % 3 == 0, "post_write_check").when(F.col("event_id") % 3 == 1, "stop_summary").otherwise("write_observed")
    results = _results(spark, sf_dir).withColumn("event", event).withColumn("outcome", F.when(F.col("event_id") % 2 == 0, "completed"))
    asked = a.review_requests(results).groupBy("user_id").agg(F.count("*").alias("asked"))
    return a.tallies(results, ["user_id"]).join(asked, "user_id", "left").na.fill(0, ["asked"])


def appended_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of the events of the log's later part, which follow those of the earlier one."""
    events = _events(spark, sf_dir).select("user_id", "event_id", "ts")
    old, new = events.where("ts < timestamp'2024-01-16'"), events.where("ts >= timestamp'2024-01-16'")
    return a.append_numbered(new, a.numbered(old, "user_id", ["ts", "event_id"]), "user_id", ["ts", "event_id"]).select("event_id", "seq")


def latest_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.latest(_results(spark, sf_dir), ["user_id"], ["ts", "event_id"])


def resolved_unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.issues(_results(spark, sf_dir), ["user_id", "checker"], ["ts", "event_id"]).select("user_id", "checker", "status", "state")


def pending_after_attest(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir)
    reviews = events.where("event_type = 'error'").select(F.col("user_id").alias("rule_id"), (F.get_json_object("props", "$.k").cast("int") % 3).alias("path"), F.col("event_id").alias("seq"))
    return a.pending_reviews(reviews, events.where("event_type = 'purchase'").select(F.col("user_id").alias("rule_id"), F.col("event_id").alias("seq")))


def session_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.numbered(_events(spark, sf_dir).select("event_id", "user_id", "ts"), "user_id", ["ts", "event_id"]).select("event_id", "user_id", F.col("seq").cast("long").alias("seq"))


def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return _events(spark, sf_dir).groupBy(k.alias("k")).agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("hundredths"))


def receipt_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("event_type") == "view", "ready").when(F.col("event_type") == "click", "authorized").otherwise("denied")
    issued, now = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6, F.unix_micros(F.to_timestamp(F.lit(NOW))) / 1e6
    valid = a.receipt_valid(status, issued, now, TTL, F.get_json_object("props", "$.k").cast("int") >= 50)
    return _events(spark, sf_dir).select("event_id", valid.alias("valid"))


def evidence_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = spark.read.parquet(f"{sf_dir}/conversations.parquet").select((F.col("conv_id") * 1000 + F.col("turn")).alias("message_id"), "text")
    rules = spark.createDataFrame([("tion",), ("eau",), ("ung",), ("thhe",)], "rule_id string")
    return a.evidence(talks, rules, POSITIVE, NEGATIVE)


def last_message_per_conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return talks.groupBy("conv_id").agg(F.max_by("role", "turn").alias("role"), F.max_by("text", "turn").alias("text"), F.count("*").alias("turns"))


def severity_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 40 foremost orders by priority, then price, then key."""
    rank = F.when(F.col("o_orderpriority").startswith("1"), 0).when(F.col("o_orderpriority").startswith("2"), 1).otherwise(2)
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.select("o_orderkey", rank.cast("long").alias("severity"), "o_totalprice").orderBy("severity", F.desc("o_totalprice"), "o_orderkey").limit(40)


QUERIES = {f.__name__: f for f in (status_counts, review_requests, appended_sequence, event_counts, latest_by_key, resolved_unresolved, pending_after_attest, session_sequence, json_props, receipt_validity, evidence_lines, last_message_per_conv, severity_topk)}
_R = "r AS (SELECT user_id, (props->>'$.k')::int % 5 AS checker, CASE event_type WHEN 'error' THEN 'fail' WHEN 'purchase' THEN 'pass' WHEN 'view' THEN 'skip' ELSE 'review' END AS status, ts, event_id FROM events)"
ORACLES = {
    "status_counts": "SELECT event_type AS policy_status, count(*) AS n FROM events WHERE event_id % 4 >= 2 AND coalesce(event_type, '') <> '' GROUP BY event_type",
    "review_requests": """SELECT user_id, count(*) FILTER (s = 'fail') AS failed, count(*) FILTER (s = 'review') AS review, count(*) FILTER (s = 'review' AND (event_id % 3 = 0 OR event_id % 3 = 1 AND event_id % 2 = 1)) AS asked
      FROM (SELECT user_id, event_id, CASE event_type WHEN 'error' THEN 'fail' WHEN 'purchase' THEN 'pass' WHEN 'view' THEN 'skip' ELSE 'review' END AS s FROM events) GROUP BY user_id""",
    "appended_sequence": "SELECT event_id, seq FROM (SELECT event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events) WHERE ts >= TIMESTAMP '2024-01-16'",
    "event_counts": "SELECT coalesce(event_type, 'unknown') AS event, count(*) AS n, count(DISTINCT user_id) AS n_users FROM events GROUP BY 1",
    "latest_by_key": f"WITH {_R} SELECT user_id, arg_max(status, (ts, event_id)) AS status, bool_or(status IN ('fail', 'error')) AS ever_failed, count(*) AS n FROM r GROUP BY user_id",
    "resolved_unresolved": f"""WITH {_R}, l AS (SELECT user_id, checker, arg_max(status, (ts, event_id)) AS status, bool_or(status = 'fail') AS failed FROM r GROUP BY user_id, checker)
      SELECT user_id, checker, status, CASE WHEN status = 'fail' THEN 'unresolved' ELSE 'resolved' END AS state FROM l WHERE status = 'fail' OR (failed AND status IN ('pass', 'skip'))""",
    "pending_after_attest": """WITH q AS (SELECT user_id AS rule_id, (props->>'$.k')::int % 3 AS path, max(event_id) AS asked FROM events WHERE event_type = 'error' GROUP BY 1, 2),
      t AS (SELECT user_id AS rule_id, max(event_id) AS cleared FROM events WHERE event_type = 'purchase' GROUP BY 1) SELECT rule_id, path, asked FROM q LEFT JOIN t USING (rule_id) WHERE cleared IS NULL OR asked > cleared""",
    "session_sequence": "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events",
    "json_props": "SELECT (props->>'$.k')::int AS k, count(*) AS n, sum(round(value * 100)::bigint)::bigint AS hundredths FROM events GROUP BY 1",
    "receipt_validity": f"""SELECT event_id, event_type IN ('view', 'click') AND epoch(TIMESTAMP '{NOW}') - epoch(ts) BETWEEN 0 AND {TTL} AND (props->>'$.k')::int >= 50 AS valid FROM events""",
    "evidence_lines": f"""SELECT message_id, rule_id, bool_or(regexp_matches(line, '(?i){POSITIVE}') AND NOT regexp_matches(line, '(?i){NEGATIVE}')) AS valid FROM
      (SELECT conv_id * 1000 + turn AS message_id, unnest(string_split_regex(text, '\\r?\\n')) AS line FROM conversations), (SELECT unnest(['tion', 'eau', 'ung', 'thhe']) AS rule_id)
      WHERE trim(line) <> '' AND contains(lower(line), rule_id) GROUP BY message_id, rule_id""",
    "last_message_per_conv": "SELECT conv_id, arg_max(role, turn) AS role, arg_max(text, turn) AS text, count(*) AS turns FROM conversations GROUP BY conv_id",
    "severity_topk": "SELECT o_orderkey, (CASE WHEN starts_with(o_orderpriority, '1') THEN 0 WHEN starts_with(o_orderpriority, '2') THEN 1 ELSE 2 END)::bigint AS severity, o_totalprice FROM orders ORDER BY severity, o_totalprice DESC, o_orderkey LIMIT 40",
}
