"""Cutting lineage through the folder that the cluster shares."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shared import shared_path


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    What comes after neither recomputes ``df`` nor depends on the executors that made it.
    """
    spark = df.sparkSession
    path = shared_path(spark, "stage")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def join_on_hot(large: DataFrame, small: DataFrame, key: str, counts: DataFrame, most: int = 10_000) -> DataFrame:
    """Inner join of ``large`` with ``small``, which has one row for each key, whatever share of ``large`` a key holds.

    ``counts`` (key, n) has the keys' numbers of rows. Those of over 1/``most`` of all rows, ``most`` keys
    at most, meet their rows by broadcast where they are; all others are shuffled.
    """
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    hot = counts.where(F.col("n") > max(1000, total // most)).select(key)
    rest = large.join(F.broadcast(hot), key, "left_anti").join(small, key)
    return rest.unionByName(large.join(F.broadcast(small.join(F.broadcast(hot), key, "left_semi")), key))
