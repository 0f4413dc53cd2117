"""Session summaries as a log comes in: facts are stored as sorted runs and merged like the digits of a counter.

Every micro-batch stores the facts of its own events as a run of level 0. Whenever ``fan`` runs of a level are complete they are merged into one of the
next, so after n batches at most ``fan`` times log n runs are current, each fact has been rewritten log n times, and which runs are current follows
from n alone. A batch reads the current runs of its own sessions, in the buckets that these fall into, to write their summaries and reports anew. A batch that is
repeated after a failure writes the same folders again; runs that a merge has replaced are deleted one batch later.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.facts import SCHEMA, facts, merge, report_lines, summary


def current_runs(batches: int, fan: int) -> list[tuple[int, int]]:
    """``(level, number)`` of the runs that together hold the first ``batches`` batches."""
    out, start, level = [], 0, 0
    while fan ** (level + 1) <= batches:
        level += 1
    for k in range(level, -1, -1):
        width = fan**k
        while start + width <= batches:
            out.append((k, start // width))
            start += width
    return out


def _run(path: str, level: int, number: int) -> str:
    return f"{path}/facts/level={level}/run={number}"


def replaced(number: int, fan: int) -> list[tuple[tuple[int, int], list[tuple[int, int]]]]:
    """The runs that batch ``number`` makes by merging, lowest level first, and those that each of them replaces."""
    out, level, done = [], 0, number + 1
    while done and done % fan == 0:
        done //= fan
        out.append(((level + 1, done - 1), [(level, fan * (done - 1) + k) for k in range(fan)]))
        level += 1
    return out


def read_facts(spark: SparkSession, path: str, runs: list[tuple[int, int]], buckets: list[int] | None = None) -> DataFrame:
    """The facts of runs, not merged yet; only those of ``buckets`` if given."""
    out = spark.createDataFrame([], f"{SCHEMA}, bucket int")
    for run in runs:
        out = out.unionByName(spark.read.schema(f"{SCHEMA}, bucket int").parquet(_run(path, *run)))
    return out if buckets is None else out.where(F.col("bucket").isin(buckets))


def _store(rows: DataFrame, place: str) -> None:
    rows.repartition("bucket").sortWithinPartitions("bucket", "session_id").write.mode("overwrite").partitionBy("bucket").parquet(place)


def take_batch(batch: DataFrame, number: int, path: str, fan: int = 8, buckets: int = 64, reports: bool = True) -> None:
    """Store one micro-batch's facts, merge runs that are due, and write the summaries and, unless only these are wanted, the reports of its sessions.

    Without ``reports`` the events' own lines, which no summary counts, are stored like all facts but not read again.
    """
    spark = batch.sparkSession
    for _, old in replaced(number - 1, fan):
        for run in old:
            place = spark._jvm.org.apache.hadoop.fs.Path(_run(path, *run))
            place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)
    bucket = F.pmod(F.xxhash64("session_id"), F.lit(buckets)).cast("int").alias("bucket")
    _store(facts(batch).select("*", bucket), _run(path, 0, number))
    for run, parts in replaced(number, fan):
        _store(merge(read_facts(spark, path, parts)).select("*", bucket), _run(path, *run))
    own = read_facts(spark, path, [(0, number)])
    touched = own.select("session_id", "bucket").distinct()
    places = sorted(r["bucket"] for r in touched.select("bucket").distinct().collect())  # at most ``buckets``
    wanted = touched.select(F.col("session_id").alias("_s"))
    held = read_facts(spark, path, current_runs(number + 1, fan), places)
    held = held if reports else held.where("kind <> 'line'")
    own_state = f"{path}/touched"  # of this batch alone; read several times below
    merge(held.join(wanted, F.col("session_id").eqNullSafe(F.col("_s")), "left_semi")).write.mode("overwrite").parquet(own_state)
    merged = spark.read.schema(SCHEMA).parquet(own_state)
    summary(merged).write.mode("overwrite").parquet(f"{path}/summaries/batch={number}")
    if reports:
        report_lines(merged).repartition("session_id").sortWithinPartitions("session_id", "section", "place").write.mode("overwrite").parquet(f"{path}/reports/batch={number}")


def summaries_as_they_come(events: DataFrame, path: str, checkpoint: str, fan: int = 8, buckets: int = 64, reports: bool = True) -> StreamingQuery:
    """Keep ``path`` up to date with a stream of events, until all that is there has been read."""
    return events.writeStream.foreachBatch(lambda batch, number: take_batch(batch, number, path, fan, buckets, reports)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, path: str, name: str = "summaries") -> DataFrame:
    """Each session's rows of ``summaries`` or ``reports`` as its last batch wrote them."""
    rows = spark.read.parquet(f"{path}/{name}")
    last = rows.groupBy(F.col("session_id").alias("_s")).agg(F.max("batch").alias("_b"))
    return rows.join(last, F.col("session_id").eqNullSafe(F.col("_s")) & (F.col("batch") == F.col("_b"))).drop("_s", "_b", "batch")
