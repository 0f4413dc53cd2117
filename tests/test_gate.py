"""The gate: transitions that compose, the fold over slices, the stream over micro-batches, and session summaries that merge."""

from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from normlake.operators import facts as f
from normlake.operators.receipts import Event, Fold, Receipt, decisions, step
from normlake.sources.records import EVENT
from normlake.streaming import receipts as stream
from normlake.streaming import summaries

TTL = 10
_events = st.lists(st.tuples(st.integers(0, 6), st.sampled_from(["prepare", "edit", "edit", "edit", "post", "post_failed", "other"]), st.sampled_from("ab"), st.sampled_from("x"), st.sampled_from([True, True, True, False])), max_size=14)
_receipts = st.one_of(st.none(), st.builds(Receipt, st.integers(-15, 0), st.sampled_from("ab"), st.just("x"), st.booleans()))


def timed(rows, start=0):
    out = []
    for gap, *rest in rows:
        start += gap
        out.append(Event(start, *rest))
    return out


def transition(events):
    own = Fold(TTL)
    for e in events:
        own.take(e)
    return own.transition()


def after(receipt, events):
    for e in events:
        receipt = step(receipt, e, TTL)[0]
    return receipt


@settings(max_examples=400, deadline=None)
@given(_events, _receipts)
def test_a_transition_does_what_its_events_do(rows, receipt):
    events = timed(rows)
    assert transition(events).apply(receipt, TTL) == after(receipt, events)


@settings(max_examples=300, deadline=None)
@given(_events, _events, _events, _receipts)
def test_transitions_compose_associatively(a, b, c, receipt):
    first = timed(a)
    second = timed(b, first[-1].at if first else 0)
    third = timed(c, second[-1].at if second else first[-1].at if first else 0)
    x, y, z = map(transition, (first, second, third))
    whole = after(receipt, first + second + third)
    assert x.then(y, TTL).then(z, TTL).apply(receipt, TTL) == whole == x.then(y.then(z, TTL), TTL).apply(receipt, TTL)


LOG = "session_id long, path string, event_id long, ts timestamp, kind string, policy_version string, bundle_id string, available boolean"


def log(n, seed=1):
    """A log in which one session has a third of the events, on one path without a prepare for days."""
    rows, x, day = [], seed, datetime(2024, 1, 1)
    for i in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        session = 1 if x % 3 == 0 else 2 + (x >> 8) % 9
        path = "hot" if session == 1 else f"p{(x >> 12) % 2}"
        kind = "edit" if session == 1 and i < n * 0.8 else ("prepare", "edit", "edit", "post", "post_failed", "look")[(x >> 16) % 6]
        rows.append((session, path, i, day + timedelta(seconds=i * 211 + (x >> 5) % 100), kind, f"v{i * 4 // n}", "b" if (x >> 20) % 11 else "c", (x >> 9) % 17 > 0))
    return rows


def plain_decisions(rows, ttl):
    out, states = set(), {}
    for session, path, event_id, ts, kind, version, bundle, available in sorted(rows, key=lambda r: (r[3], r[2])):
        at = round((ts - datetime(1970, 1, 1)).total_seconds() * 1e6)
        states[session, path], decision = step(states.get((session, path)), Event(at, kind, version, bundle, available), ttl * 1_000_000)
        if decision:
            out.add((session, path, event_id, kind, decision))
    return out


@pytest.mark.parametrize("slice_seconds", [60, 3600, 86_400, 10**9])
def test_slices_change_nothing(spark, slice_seconds):
    rows = log(900)
    found = decisions(spark.createDataFrame(rows, LOG), 900, slice_seconds).collect()
    assert {tuple(r) for r in found} == plain_decisions(rows, 900) and len(found) == len({r["event_id"] for r in found})


def test_receipts_belong_to_a_path_and_a_bundle_and_a_write_consumes_them(spark):
    rows = [
        ("a", 1, 0, "prepare", "v", "b"), ("z", 2, 1, "edit", "v", "b"),  # another file isn't covered
        ("a", 3, 2, "edit", "v", "b"), ("a", 4, 3, "edit", "v", "b"), ("a", 5, 4, "post", "v", "b"), ("a", 6, 5, "post", "v", "b"),  # used till a write
        ("a", 7, 6, "edit", "v", "b"), ("a", 8, 7, "edit", "v", "c"), ("a", 9, 8, "edit", "v", "c"), ("a", 10, 9, "post", "w", "c"),  # bundle, version
        ("a", 11, 20, "prepare", "v", "b"), ("a", 12, 921, "edit", "v", "b"), ("a", 13, 922, "post", "v", "b"), (None, 14, 923, "edit", None, None), (None, 15, 924, "edit", None, None),
    ]
    events = spark.createDataFrame([(1, p, i, datetime(2024, 1, 1) + timedelta(seconds=t), k, v, b) for p, i, t, k, v, b in rows], LOG.removesuffix(", available boolean"))
    found = {r["event_id"]: r["decision"] for r in decisions(events, 900, 60).collect()}
    assert found == {2: "denied", 3: "authorized", 4: "authorized", 5: "checked", 6: "unauthorized", 7: "denied", 8: "denied", 9: "authorized", 10: "unauthorized", 12: "denied", 13: "unauthorized", 14: "denied", 15: "authorized"}
    assert decisions(events.limit(0)).count() == 0


def test_the_stream_decides_as_the_batch_does(spark, tmp_path):
    rows = log(240)
    came = sorted(rows, key=lambda r: (r[2] // 20, -r[2]))  # out of order within an hour
    end = max(r[3] for r in rows)
    came.append((99, "end", 10_000, end + timedelta(days=40), "edit", "v", "b", True))
    spark.conf.set(*stream.STATE_STORE)
    try:
        for k in range(3):  # three runs of one query, each restarted from its checkpoint
            part = came[k * 80 : (k + 1) * 80] if k < 2 else came[160:]
            for j in range(0, len(part), 40):
                spark.createDataFrame(part[j : j + 40], LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            events = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
            decided = stream.receipts(events, 900, "2 hours", 90 * 86_400)
            query = decided.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
            query.awaitTermination()
    finally:
        spark.conf.unset(stream.STATE_STORE[0])
    found = [tuple(r) for r in spark.read.schema(stream.OUTPUT).parquet(str(tmp_path / "out")).collect()]
    assert sorted(found) == sorted((str(s), *rest) for s, *rest in plain_decisions(rows, 900))


def test_which_runs_are_current():
    for fan in (2, 3, 8):
        held = set()
        for n in range(70):
            held.add((0, n))
            for run, parts in summaries.replaced(n, fan):
                assert set(parts) <= held
                held = held - set(parts) | {run}
            assert sorted(held) == sorted(summaries.current_runs(n + 1, fan))
            assert sum(fan**level for level, _ in held) == n + 1 and len(held) <= fan * 8


def test_merged_facts_are_those_of_the_whole_log(spark, tmp_path):
    result = lambda rule, status, path="p", blocking=True: (rule, "c", status, "major", "m|x", path, 1, "", "", blocking)
    rows = [
        ("1", "2024-01-01", "s1", "post_write_check", "a", "matched", None, ["R1", "", None], [result("R1", "fail"), result("", "error"), result("R2", "review")]),
        ("2", "2024-01-02", "s1", "ai_review_self_attested", None, None, None, ["R2"], None),
        ("3", "2024-01-03", "s1", "post_write_check", "b", "matched", None, None, [result("R1", "pass")]),
        ("4", "2024-01-04", "s1", None, "", "", "odd\n thing", None, []),
        ("5", "2024-01-05", "s2", "stop_summary", None, "none", "blocked", ["R9"], [result("R3", "review", None), result("R3", "review", " ")]),
        ("6", "2024-01-06", None, "stop_summary", None, "none", "completed", ["R9"], [result("R3", "review")]),
    ]
    full = [(1, i, t, s, e, p, ps, "v", o, m, r) for i, t, s, e, p, ps, o, m, r in rows]
    events = spark.createDataFrame(full, EVENT)
    whole = f.facts(events)
    parts = f.merge(f.facts(events.where("event_id < 3")).unionByName(f.facts(events.where("event_id >= 3"))))
    order = lambda df: sorted(map(str, df.collect()))
    assert order(whole) == order(parts)
    by = {r["session_id"]: r for r in f.summary(whole).collect()}
    s1 = by["s1"]
    assert (s1["events"], s1["changed_files"], s1["matched_rules"], s1["failed_rules"], s1["blocking_failures"], s1["unresolved"], s1["resolved"], s1["pending_reviews"]) == (4, 2, 2, 1, 2, 1, 1, 0)
    assert by["s2"]["pending_reviews"] == 1 and by[None]["pending_reviews"] == 0
    lines = [r["line"] for r in f.report_lines(whole).where("session_id = 's1'").orderBy("section", "place").collect()]
    assert lines[:2] == ["# Session s1", "- State: 1 unresolved"] and "- UNKNOWN-RULE / p / c: m\\|x" in lines
    assert lines[-4:] == ["| 2024-01-01 | post_write_check | a | matched | failed 2, to review 1 |", "| 2024-01-02 | ai_review_self_attested | — | — | — |", "| 2024-01-03 | post_write_check | b | matched | passed |", "| 2024-01-04 | unknown | — | — | odd thing |"]
    # In micro-batches, one of them repeated after a failure.
    for n in range(6):
        batch = events.where(F.col("event_id") == str(n + 1))
        for _ in range(2 if n in (1, 3) else 1):
            summaries.take_batch(batch, n, str(tmp_path), fan=2, buckets=3)
    assert order(summaries.latest(spark, str(tmp_path)).select(f.summary(whole).columns)) == order(f.summary(whole))
    assert order(summaries.latest(spark, str(tmp_path), "reports").select("session_id", "section", "place", "line")) == order(f.report_lines(whole))
    runs = {p.parent.name + "/" + p.name for p in (tmp_path / "facts").glob("*/*")}
    assert {"level=2/run=0", "level=1/run=2"} <= runs and "level=0/run=1" not in runs


def test_a_batch_reads_its_own_sessions_alone(spark, tmp_path):
    event = lambda i, s: (1, str(i), f"2024-01-{i:02d}", s, "stop_summary", None, None, None, "completed", None, None)
    for n in range(3):
        summaries.take_batch(spark.createDataFrame([event(n + 1, f"s{n}")], EVENT), n, str(tmp_path), fan=8, buckets=50)
        assert [r["session_id"] for r in spark.read.parquet(f"{tmp_path}/summaries/batch={n}").collect()] == [f"s{n}"]
        assert spark.read.parquet(f"{tmp_path}/touched").select("session_id").distinct().count() == 1


def test_summaries_alone_are_the_same_and_all_facts_are_kept(spark, tmp_path):
    event = lambda i, s: (1, str(i), f"2024-01-{i:02d}", s, "post_write_check", "p", None, None, "completed", ["R"], None)
    events = [[event(1, "a"), event(2, "b")], [event(3, "a")]]
    for place, reports in (("all", True), ("short", False)):
        for n, batch in enumerate(events):
            summaries.take_batch(spark.createDataFrame(batch, EVENT), n, f"{tmp_path}/{place}", fan=2, buckets=2, reports=reports)
    found = [sorted(map(str, summaries.latest(spark, f"{tmp_path}/{p}").collect())) for p in ("all", "short")]
    assert found[0] == found[1] and not (tmp_path / "short" / "reports").exists()
    assert spark.read.parquet(f"{tmp_path}/short/facts/level=1").where("kind = 'line'").count() == 3
    assert spark.read.parquet(f"{tmp_path}/short/touched").where("kind = 'line'").count() == 0
