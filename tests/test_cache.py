"""The write-back cache and runtime retrieval."""

import json
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from normlake.operators import bundles, runtime
from normlake.sources import cache

COLUMNS = "v array<double>"


@pytest.fixture
def asked(tmp_path):
    """A provider that notes what it is asked, and what it was asked so far."""
    place = str(tmp_path / "asked")

    def provider(batches, place=place, wrong=""):
        for b in batches:
            with open(place, "a") as f:
                f.writelines(f"{t}\n" for t in b["text"])
            yield pd.DataFrame({"key": b["key"], "v": [[1.0] if wrong and wrong in t else [float(len(t)), 2.0] for t in b["text"]]})

    return provider, lambda: sorted(open(place).read().split()) if os.path.exists(place) else []


def keyed(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "text string").withColumn("key", cache.key_of("e", "m", F.col("text"), 2))


def test_a_key_is_asked_for_once(spark, tmp_path, asked):
    provider, said = asked
    path, size = (tmp_path / "cache").as_uri(), F.size("v") == 2
    rows = cache.filled(keyed(spark, "a", "bb", "a"), path, provider, COLUMNS, size).collect()
    assert {(tuple(r["v"]), r["cached"]) for r in rows} == {((1.0, 2.0), False), ((2.0, 2.0), False)} and len(rows) == 2 and said() == ["a", "bb"]
    rows = cache.filled(keyed(spark, "a", "ccc"), path, provider, COLUMNS, size, batches=3).collect()
    assert {(r["v"][0], r["cached"]) for r in rows} == {(1.0, True), (3.0, False)} and said() == ["a", "bb", "ccc"]
    assert all(r["cached"] for r in cache.filled(keyed(spark, "a", "bb", "ccc"), path, provider, COLUMNS, size).collect()) and len(said()) == 3
    assert cache.filled(keyed(spark, "a").limit(0), path, provider, COLUMNS).count() == 0


def test_what_a_key_depends_on(spark):
    one = spark.range(1)
    keys = [one.select(cache.key_of(*a[:2], F.lit(a[2]), a[3])).first()[0] for a in (("e", "m", "t", 2), ("f", "m", "t", 2), ("e", "n", "t", 2), ("e", "m", "u", 2), ("e", "m", "t", 3), ("e", "m", "t", None), ("e", "m", None, 2))]
    assert len(set(keys)) == len(keys)


def test_a_failed_batch_leaves_no_entry_and_earlier_ones_stay(spark, tmp_path, asked):
    provider, said = asked
    path, size, texts = (tmp_path / "cache").as_uri(), F.size("v") == 2, [f"t{i}." for i in range(40)]
    whole = keyed(spark, *texts)
    last = whole.where(F.pmod(F.xxhash64("key"), F.lit(4)) == 2).first()["text"]
    with pytest.raises(Exception, match="missing, unasked or invalid"):
        cache.filled(whole, path, lambda b: provider(b, wrong=last), COLUMNS, size, batches=4)
    kept = {r["key"] for r in cache.read(spark, path, COLUMNS).collect()}
    assert kept == {r["key"] for r in whole.where(F.pmod(F.xxhash64("key"), F.lit(4)) < 2).collect()}
    before = len(said())
    assert cache.filled(whole, path, provider, COLUMNS, size, batches=4).count() == 40 and len(said()) - before == 40 - len(kept)
    with pytest.raises(Exception, match="missing, unasked or invalid"):
        cache.filled(keyed(spark, "new"), path, lambda batches: (b[["key"]].assign(v=[[1.0, 2.0]] * len(b)).iloc[:0] for b in batches), COLUMNS, size)
    assert cache.read(spark, path, COLUMNS).count() == 40


def test_runtime_rules(spark, tmp_path):
    record = lambda i, **more: json.dumps({"id": f"R{i}", "title": f"rule {i}", "statement": "use ThreadPool here" if i < 3 else "never call Map.of", "scope": "company" if i % 2 else "project", "category": "coding", "severity": "major", "source": {"document": "d", "section": "s"}, "trigger_terms": [], "tags": [], "metadata": more})
    checks = {"checks": [{"type": "regex_forbid", "pattern": "x", "include_paths": ["*.java"]}, {"type": "ai_review"}]}
    rows = spark.createDataFrame([(f"R{i}", "s", record(i, **(checks if i in (1, 4) else {}))) for i in range(6)], "rule_id string, statement string, record string").withColumn("hash", F.sha2("record", 256))
    rows = rows.withColumn("statement", F.get_json_object("record", "$.statement"))
    decisions = rows.select("rule_id", F.lit("approved").alias("decision"), F.col("hash").alias("review_hash"), F.lit("").alias("edited"), F.lit("").alias("notes"))
    vectors = spark.createDataFrame([("R0", [1.0, 0.0]), ("R5", [0.0, 1.0])], "rule_id string, v array<double>")
    bundles.activate(rows, decisions, tmp_path.as_uri(), "v1", vectors=vectors)
    bundle = bundles.read_bundle(spark, tmp_path.as_uri())
    queries = spark.createDataFrame([(1, "ThreadPool", "A.java", None, [0.0, 1.0]), (2, None, "b.txt", "", None)], "query_id long, query string, path string, code string, q array<double>")
    found = {(r["query_id"], r["place"]): r for r in runtime.runtime_rules(bundle, queries, 3).collect()}
    assert [found[1, p]["rule_id"] for p in (1, 2)] == ["R1", "R4"] and all(found[1, p]["direct"] and found[1, p]["checkers"] == ["ai_review", "regex_forbid"] for p in (1, 2))
    assert found[1, 1]["score"] > 0 and found[1, 2]["score"] is None and not found[1, 3]["direct"] and found[1, 3]["title"].startswith("rule") and len([k for k in found if k[0] == 1]) == 3
    assert not [k for k in found if k[0] == 2]
    one = runtime.runtime_rules(bundle, queries, 1).collect()
    assert {r["rule_id"] for r in one} == {"R1", "R4"}  # direct rules are exempt from the limit
    assert runtime.runtime_rules(bundle, queries, 0).count() == 0
    assert {r["rule_id"] for r in runtime.runtime_rules(bundle, queries, 9, scopes="Company").collect()} <= {"R1", "R3", "R5"}
    assert "R5" in {r["rule_id"] for r in runtime.runtime_rules(bundle, queries, 9).collect()}  # by its vector alone
