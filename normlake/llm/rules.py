"""Operator 10, quality rules: base counts and a hashed n-gram log-likelihood ratio, in DataFrame functions throughout.

Words and word pairs are hashed to ``buckets`` buckets. Two multinomials over them, one of the trusted target
and one of the raw corpus (all rows), give each bucket a log-likelihood ratio; a document's verdict is
the sum over its n-grams divided by their number, against a fixed threshold. The counts are partially aggregated
before the shuffle, so a map task sends at most ``buckets`` rows; the table of ratios, ``buckets``
numbers whatever the size of the corpus, reaches the second pass as a scalar subquery.

The target is taken from the rows labelled good, at most ``target_rows`` of them (lowest hashed ids first); the raw
counts cover every row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"


@dataclass(frozen=True)
class RuleParams:
    buckets: int = 1 << 15
    target_rows: int = 20_000
    threshold: float = -0.09
    least_words: int = 50
    symbols: str = "#*$%&|<>"


def words_of(text: Column) -> Column:
    """The maximal runs without space and U+0009 to U+000D."""
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def base_counts(docs: DataFrame, params: RuleParams = RuleParams()) -> DataFrame:
    """From ``doc_id, text``: the base columns and ``words``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    first = docs.select("doc_id", words_of(text).alias("words"), lines.alias("lines"), (F.length(text) - F.length(F.translate(text, params.symbols, ""))).cast("long").alias("n_symbols"))
    n = F.size("words")
    # The hash of each run of three words with its place, in order of the hashes: equal runs stand side by side.
    runs = F.transform(F.slice("words", 1, F.greatest(n - 2, F.lit(0))), lambda w, i: F.struct(F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2)).alias("h"), i.alias("i")))
    second = first.select("doc_id", "words", "n_symbols", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), F.sort_array(runs).alias("runs"))
    again = F.filter(F.transform("runs", lambda r, j: F.when((r["h"] == F.get("runs", j - 1)["h"]) | (r["h"] == F.get("runs", j + 1)["h"]), r["i"])), lambda i: i.isNotNull())
    third = second.select("doc_id", "words", "n_symbols", "n_dup_lines", F.sort_array(again).alias("again"))
    # Each run covers three words, fewer where the next one begins among them.
    covered = F.aggregate(F.transform("again", lambda i, j: F.coalesce(F.least(F.lit(3), F.get("again", j + 1) - i), F.lit(3)).cast("long")), F.lit(0).cast("long"), lambda a, b: a + b)
    chars = F.aggregate(F.transform("words", lambda w: F.length(w).cast("long")), F.lit(0).cast("long"), lambda a, b: a + b)
    fourth = third.select("doc_id", "words", n.cast("long").alias("n_words"), chars.alias("word_chars"), "n_symbols", "n_dup_lines", covered.alias("n_repeat_words"))
    failed = (F.col("n_words") < params.least_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return fourth.withColumn("base_failed", failed)


def grams(words: Column, buckets: int) -> Column:
    """The buckets of a document's words and word pairs."""
    single = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int"))
    pairs = F.transform(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), lambda w, i: F.pmod(F.xxhash64(w, F.get(words, i + 1)), F.lit(buckets)).cast("int"))
    return F.concat(single, pairs)


def ratios(docs: DataFrame, target: DataFrame, params: RuleParams = RuleParams()) -> DataFrame:
    """One row with ``ratios``: the log-likelihood ratio of each bucket (all zero without a target).

    ``docs`` has ``doc_id, text``; ``target`` has up to ``target_rows`` ids (``doc_id``).
    """
    ids = target.select(F.col("doc_id").alias("_t")).where("_t is not null").distinct()
    rows = docs.join(F.broadcast(ids), docs["doc_id"] == ids["_t"], "left").select(words_of(F.coalesce("text", F.lit(""))).alias("words"), F.col("_t").isNotNull().cast("int").alias("t"))
    counted = rows.select(F.explode(grams(F.col("words"), params.buckets)).alias("bucket"), "t").groupBy("bucket").agg(F.count("*").alias("r"), F.sum("t").alias("t"))
    full = docs.sparkSession.range(params.buckets).withColumnRenamed("id", "bucket").join(counted, "bucket", "left").select("bucket", F.coalesce("r", F.lit(0)).alias("r"), F.coalesce("t", F.lit(0)).alias("t"))
    listed = full.agg(F.array_sort(F.collect_list(F.struct("bucket", "r", "t"))).alias("all"), F.sum("r").alias("nr"), F.sum("t").alias("nt"))
    ratio = F.transform("all", lambda x: F.when(F.col("nt") == 0, F.lit(0.0)).otherwise(F.log((x["t"] + 1) / (F.col("nt") + params.buckets)) - F.log((x["r"] + 1) / (F.col("nr") + params.buckets))))
    return listed.select(ratio.alias("ratios"))


def judge(docs: DataFrame, target: DataFrame, params: RuleParams = RuleParams(), text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Base columns, ``base_failed``, ``ratio`` (length-normalised) and ``kept`` of every row.

    Defined results: a null or empty text has no words, fails the base rules and has ratio 0; repeated rows are
    judged each time; without a target all ratios are 0; an empty table gives no rows. Other
    columns aren't read.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    # ``buckets`` numbers, whatever the table's size: as a constant of the expression they aren't copied onto each row.
    known = ratios(rows, target, params).select(F.to_json("ratios").alias("r")).first()["r"]
    table = F.from_json(F.lit(known), "array<double>")
    counted = base_counts(rows, params).withColumn("grams", grams(F.col("words"), params.buckets))
    total = F.aggregate("grams", F.lit(0.0), lambda a, b: a + F.get(table, b))
    scored = counted.withColumn("ratio", F.when(F.size("grams") == 0, 0.0).otherwise(total / F.size("grams")))
    return scored.drop("words", "grams").withColumn("kept", ~F.col("base_failed") & (F.col("ratio") >= params.threshold))


def target_ids(labels: DataFrame, label: str = "quality", rows: int = RuleParams.target_rows, doc_id: str = "doc_id") -> DataFrame:
    """Ids of rows that the label marks good, ``rows`` of them at most."""
    good = labels.where(F.col(label) == 1).select(F.col(doc_id).alias("doc_id")).where("doc_id is not null").distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
