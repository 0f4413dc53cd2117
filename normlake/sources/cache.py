"""What a provider said, kept by the hash of what it was asked: committed in whole batches, read only where a batch is whole.

A cache is a folder of batches, each written once under a name of its own. Spark writes a batch's ``_SUCCESS`` last, when all its tasks are through, and a
batch without it isn't read: what failed half-way leaves no entry. Misses are asked for once each, whatever their number of rows, in
batches by hash, so that what was paid for before a failure stays. If two runs ask for the same key at once, the answer of the batch whose name sorts first counts for both.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.canonical import canonical_json

#: Maps batches of the misses to batches of ``key`` and the answer's columns.
Provider = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def key_of(purpose: str, model: str, text: Column, dimensions: int | None = None) -> Column:
    """The hash of a purpose, a model, its number of dimensions and a text: any other of these is another key."""
    fields = {"purpose": (F.lit(purpose), T.StringType()), "model": (F.lit(model), T.StringType()), "dimensions": (F.lit(dimensions).cast("int"), T.IntegerType()), "text": (text.cast("string"), T.StringType())}
    return F.sha2(canonical_json(fields), 256)


def _batches(spark: SparkSession, path: str) -> list[str]:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not fs.exists(place):
        return []
    found = [s.getPath() for s in fs.listStatus(place) if s.isDirectory()]
    return sorted(f.getName() for f in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f, "_SUCCESS")))


def read(spark: SparkSession, path: str, columns: str, only: list[str] | None = None) -> DataFrame:
    """``key`` and ``columns`` of all whole batches (or ``only`` some), each key once."""
    schema = f"key string, {columns}"
    names = [f.name for f in T.StructType.fromDDL(columns).fields]
    parts = [f"{path}/{b}" for b in (_batches(spark, path) if only is None else only)]
    rows = spark.read.schema(schema).parquet(*parts) if parts else spark.createDataFrame([], schema)
    batch = F.regexp_extract(F.input_file_name(), r"/([^/]+)/[^/]+$", 1)
    first = rows.select("key", F.struct(*names).alias("x"), batch.alias("b")).groupBy("key").agg(F.min_by("x", "b").alias("x"))
    return first.select("key", *[F.col(f"x.{n}").alias(n) for n in names])


def filled(keyed: DataFrame, path: str, provider: Provider, columns: str, valid: Column | None = None, batches: int = 1) -> DataFrame:
    """``key``, ``columns`` and ``cached`` for every distinct key of ``keyed``; new answers are in the cache when this returns.

    The provider sees ``keyed``'s columns, each missing key once. An answer that isn't ``valid`` (vectors of another size, say), that has no key it was asked for, or a key without one
    fails its batch: it isn't committed, earlier ones are, and the error is raised. A second run asks for nothing that is there.
    """
    spark = keyed.sparkSession
    before = _batches(spark, path)
    known = read(spark, path, columns, before).select("key")
    run = uuid.uuid4().hex
    missing = keyed.where("key is not null").join(known, "key", "left_anti").dropDuplicates(["key"])
    for b in range(batches):
        share = missing.where(F.pmod(F.xxhash64("key"), F.lit(batches)) == b) if batches > 1 else missing
        if not share.isEmpty():
            said = share.mapInPandas(provider, f"key string, {columns}")
            # One row for each key that was asked for, and none besides.
            both = share.select("key", F.lit(True).alias("_asked")).join(said.withColumn("_said", F.lit(True)), "key", "full")
            good = F.col("_asked").isNotNull() & F.col("_said").isNotNull() & (F.lit(True) if valid is None else F.coalesce(valid, F.lit(False)))
            checked = both.withColumn("key", F.when(good, F.col("key")).otherwise(F.raise_error(F.concat(F.lit("the provider's answer is missing, unasked or invalid: "), F.col("key"))))).drop("_asked", "_said")
            checked.write.parquet(f"{path}/{run}-{b:06d}")
    return keyed.where("key is not null").select("key").distinct().join(read(spark, path, columns), "key").join(known.withColumn("cached", F.lit(True)), "key", "left").withColumn("cached", F.coalesce("cached", F.lit(False)))
