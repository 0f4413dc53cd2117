"""Gates over an event log: may this edit be written, may this task end? Receipts, evidence and cards, as joins and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# What a reviewer's line says if it clears a rule, and what takes that back.
CLEARED = r"(?:审查通过|结论\s*[:：]\s*通过|已修复|无未解决(?:问题|项)|仅建议\s*[,，；;:]?\s*无阻断|\bpass(?:ed)?\b|\bcompliant\b)"
OPEN = r"(?:未通过|不通过|未修复|仍有|尚有|(?<!不)存在(?:严重)?问题|有阻断|不符合|无法确认|\bfail(?:ed)?\b|\bnon[- ]compliant\b|\bunresolved\b)"


def before_in_session(events: DataFrame, session: str, order: list[str], value: Column, name: str) -> DataFrame:
    """Add ``name``: ``value`` (null: none) of the last event before each in its session that has one.

    A session's events are ordered by slices of the order's first column (days), and what a slice ends with is carried to the next, so a
    session that holds a large part of the log is spread over its slices.
    """
    sliced = events.withColumn("_slice", F.to_date(order[0])).withColumn("_v", value)
    within = Window.partitionBy(session, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    at = F.struct(*order)
    ends = sliced.groupBy(session, "_slice").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), at)).alias("_end"))
    slices = Window.partitionBy(session).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("_carried", F.last("_end", ignorenulls=True).over(slices)).select(session, "_slice", "_carried")
    own = sliced.withColumn("_own", F.last("_v", ignorenulls=True).over(within))
    return own.join(carried, [session, "_slice"]).withColumn(name, F.coalesce("_own", "_carried")).drop("_slice", "_v", "_own", "_carried")


def merge_cards(direct: DataFrame, prepared: DataFrame, ranked: DataFrame, limit: int) -> DataFrame:
    """Cards for each query, each id once: direct ones, all of them, then prepared and ranked ones up to ``limit``; ``origin, place``.

    All have ``query_id, id, at`` (the order within its kind).
    """
    kinds = [rows.select("query_id", "id", "at", F.lit(k).alias("kind")) for k, rows in enumerate((direct, prepared, ranked))]
    first = kinds[0].unionByName(kinds[1]).unionByName(kinds[2]).where("id <> ''").groupBy("query_id", "id").agg(F.min(F.struct("kind", "at")).alias("m"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("m", "id"))
    origin = F.element_at(F.array(*map(F.lit, ("direct", "prepared", "ranked"))), F.col("m.kind") + 1)
    return first.withColumn("place", place).where((F.col("m.kind") == 0) | (F.col("place") <= limit)).select("query_id", "id", origin.alias("origin"), F.col("place").cast("long").alias("place"))


def stop_gate(results: DataFrame, evidence: DataFrame, fail_closed: bool = True) -> DataFrame:
    """May each task end? ``session_id, outcome, blocking, reviews, unproven``.

    ``results`` has ``session_id, rule_id, status, blocking``; ``evidence`` has ``session_id, rule_id, valid`` from the last message. Blocking failures (errors too
    if ``fail_closed``) block; else reviews without a valid line of their own hold the task; else it is completed.
    """
    stops = F.col("status").isin("fail", "error") & (F.col("blocking") | (F.lit(fail_closed) & (F.col("status") == "error")))
    reviews = results.where("status = 'review'").select("session_id", "rule_id").distinct().join(evidence.groupBy("session_id", "rule_id").agg(F.bool_or("valid").alias("valid")), ["session_id", "rule_id"], "left")
    asked = reviews.groupBy("session_id").agg(F.count("*").alias("reviews"), F.count_if(~F.coalesce("valid", F.lit(False))).alias("unproven"))
    held = results.groupBy("session_id").agg(F.count_if(stops).alias("blocking")).join(asked, "session_id", "left").na.fill(0, ["reviews", "unproven"])
    outcome = F.when(F.col("blocking") > 0, "blocked").when(F.col("unproven") > 0, "review_required").otherwise("completed")
    return held.select("session_id", outcome.alias("outcome"), "blocking", "reviews", "unproven")
