"""The gate as a stream: the event log is read incrementally, and receipts are state by session and path, in event time.

Events wait in state until the watermark has passed them and are then judged in order of time, by the same steps as a whole log's
(``operators.receipts``), so late ones, up to ``late``, count in their place and what is decided doesn't depend on how the log was cut into micro-batches. A ready receipt goes by a timer once its
time to live has passed, one that was used after ``keep``: a write that is reported later counts as unauthorized.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from ..operators.receipts import KINDS, Event, Receipt, step

OUTPUT = "session_id string, path string, event_id long, kind string, decision string"
#: What transformWithState keeps its state in; set before a query starts.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Gate(StatefulProcessor):
    """For one session's share of paths: events that wait, a map of receipts by path, and timers for both."""

    def __init__(self, ttl: int, keep: int) -> None:
        self.ttl, self.keep = ttl, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "path string, event_id long, at long, kind string, version string, bundle string, available boolean")
        self.receipts = handle.getMapState("receipts", "path string", "issued long, version string, bundle string, authorized boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        taken = [(r["path"], r["event_id"], r["at"], r["kind"], r["policy_version"], r["bundle_id"], r["available"]) for r in rows]
        self.waiting.appendList(taken)
        self.handle.registerTimer(_ms(min(r[2] for r in taken)))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        held = sorted(self.waiting.get(), key=lambda r: (r[2], r[1])) if self.waiting.exists() else []
        due = [r for r in held if _ms(r[2]) <= now]
        if due:
            rest = held[len(due) :]
            if rest:
                self.waiting.put(rest)
                self.handle.registerTimer(_ms(rest[0][2]))
            else:
                self.waiting.clear()
        yield from self._judge(key, due)
        self._expire(now)

    def _judge(self, key: tuple, due: list[tuple]) -> Iterator[Row]:
        states: dict[str, Receipt | None] = {}
        for path, event_id, *event in due:
            if path not in states:
                found = self.receipts.getValue((path,))
                states[path] = Receipt(*found) if found is not None else None
            states[path], decision = step(states[path], Event(*event), self.ttl)
            if decision:
                yield Row(session_id=key[0], path=path or None, event_id=event_id, kind=event[1], decision=decision)
        for path, receipt in states.items():
            if receipt is not None:
                self.receipts.updateValue((path,), tuple(receipt))
                self.handle.registerTimer(self._end(receipt))
            elif self.receipts.containsKey((path,)):
                self.receipts.removeKey((path,))

    def _end(self, receipt: Receipt) -> int:
        return _ms(receipt.issued + (self.keep if receipt.authorized else self.ttl)) + 1

    def _expire(self, now: int) -> None:
        if self.receipts.exists():
            for key, value in list(self.receipts.iterator()):
                if self._end(Receipt(*value)) <= now:
                    self.receipts.removeKey(tuple(key))

    def close(self) -> None:
        pass


def _ms(micros: int) -> int:
    return -(-micros // 1000)


def receipts(events: DataFrame, ttl_seconds: int = 900, late: str = "1 hour", keep_seconds: int = 86_400, shares: int = 16) -> DataFrame:
    """Decisions, as :func:`operators.receipts.decisions` makes them, for a stream of the same columns; ``ts`` is a timestamp.

    A session's paths are dealt to ``shares`` keys, so a session with a large part of the log is spread.
    Needs ``STATE_STORE`` in the session's configuration.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    ready = F.coalesce("available", F.lit(True)) if "available" in events.columns else F.lit(True)
    timed = events.where(F.col("kind").isin(*KINDS) & F.col("ts").isNotNull()).withWatermark("ts", late)
    keyed = timed.select(F.col("session_id").cast("string").alias("session_id"), F.pmod(F.xxhash64("path"), F.lit(shares)).alias("share"), text("path"), F.col("event_id").cast("long").alias("event_id"), "ts", F.unix_micros("ts").alias("at"), "kind", text("policy_version"), text("bundle_id"), ready.alias("available"))
    gate = Gate(max(1, ttl_seconds) * 1_000_000, max(1, keep_seconds) * 1_000_000)
    return keyed.groupBy("session_id", "share").transformWithState(gate, OUTPUT, "Append", "EventTime")


def report_as_it_comes(events: DataFrame, path: str, checkpoint: str, report: Callable[[DataFrame], DataFrame], session: str = "session_id") -> StreamingQuery:
    """Append each micro-batch of events below ``path/log`` and write the reports of its sessions anew, each to ``path/reports/batch=N``.

    A reader takes a session's report from the greatest batch. A batch that is repeated after a failure writes the same folders.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{path}/log/batch={number}")
        log = spark.read.option("basePath", f"{path}/log").parquet(f"{path}/log").where(F.col("batch") <= number).drop("batch")
        touched = spark.read.parquet(f"{path}/log/batch={number}").select(session).distinct()
        report(log.join(touched, session, "left_semi")).write.mode("overwrite").parquet(f"{path}/reports/batch={number}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_stream(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A table's files as a stream, whether the table is one file or a folder of parts."""
    place = f"{folder}/{table}.parquet"
    schema = spark.read.parquet(place).schema
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    rows = spark.readStream.schema(schema)
    if path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getFileStatus(path).isDirectory():
        return rows.parquet(place)
    return rows.option("pathGlobFilter", f"{table}.parquet").option("recursiveFileLookup", False).parquet(folder)


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts by event type and window of event time, once the watermark has closed the window."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
