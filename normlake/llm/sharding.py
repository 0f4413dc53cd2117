"""Operator 6, sharding: Hilbert-curve ordering, in DataFrame functions throughout.

Four metadata dimensions (language, source, size, id) are quantised to ``bits`` bits each; rows are
sorted by their cell's index on the Hilbert curve through the four-dimensional grid and cut into runs of equal
row counts. Neighbours on the curve are neighbours in all dimensions, so each shard's files span small
ranges of several columns at once and readers can skip the others. Ties on the curve are broken by text and id.

Ranks come from a range partitioning over the whole sort key, which splits any hot cell, and from the row
counts of its partitions; no row passes through a single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .staging import stage


def with_hilbert_index(df: DataFrame, axes: list[str], bits: int, name: str = "curve") -> DataFrame:
    """Add the index on the Hilbert curve of the cell with these coordinates (longs, 0 to 2**bits - 1 each).

    Each step is a projection of its own whose columns are used more than once, so Spark computes each of
    them once per row. ``axes`` are consumed.
    """
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for axis in axes:
            first, own = F.col(axes[0]), F.col(axis)
            flipped = own.bitwiseAND(1 << b) != 0
            # Undo the curve's turns: flip the first axis' lower bits, or exchange them with this axis'.
            swap = first.bitwiseXOR(own).bitwiseAND(low)
            new = {axes[0]: F.when(flipped, first.bitwiseXOR(low)).otherwise(first.bitwiseXOR(swap))}
            if axis != axes[0]:
                new[axis] = F.when(flipped, own).otherwise(own.bitwiseXOR(swap))
            df = df.withColumns(new)
    # Gray code: each axis takes in the one before it; then the last one's high bits flip the lower bits of all.
    for before, axis in zip(axes, axes[1:]):
        df = df.withColumn(axis, F.col(axis).bitwiseXOR(F.col(before)))
    flips = F.lit(0).cast("long")
    for b in range(1, bits):
        flips = flips.bitwiseXOR(F.when(F.col(axes[-1]).bitwiseAND(1 << b) != 0, F.lit((1 << b) - 1)).otherwise(F.lit(0)).cast("long"))
    df = df.withColumn("_flips", flips)
    index = F.lit(0).cast("long")
    for b in range(bits - 1, -1, -1):
        for axis in axes:
            index = F.shiftleft(index, 1).bitwiseOR(F.shiftright(F.col(axis).bitwiseXOR(F.col("_flips")), b).bitwiseAND(1))
    return df.withColumn(name, index).drop("_flips", *axes)


def _bucket(column: Column, bits: int) -> Column:
    """A string's cell: the same for equal values, 0 for null."""
    return F.coalesce(F.pmod(F.xxhash64(column), F.lit((1 << bits) - 1)) + 1, F.lit(0)) if bits else F.lit(0)


def shard_by_curve(docs: DataFrame, shards: int = 8, bits: int = 4, text: str = "text", lang: str = "lang", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard, curve`` of every row, by the law ``rows``.

    Shard counts differ by one at most, slots are gapless from 0, ``grown_shard`` is null (only a law by key has
    one). Defined results: a null text has size 1 and the empty text's CRC-32; null dimensions share a cell
    (the first); repeated rows take a slot each; an empty table gives no rows. Other columns aren't read.
    """
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.col(lang).cast("string").alias("l"), F.col(source).cast("string").alias("s"))
    ends = docs.select(F.col(doc_id).cast("long").alias("d")).agg(F.min("d").alias("a"), F.max("d").alias("b")).first()
    low, high = ends["a"] or 0, ends["b"] or 0
    cells = 1 << bits
    place = F.coalesce(F.floor((F.col("doc_id").cast("double") - low) * cells / (float(high) - low + 1.0)).cast("long"), F.lit(0))
    weight = F.least(F.floor(F.log2(F.col("size"))).cast("long"), F.lit(cells - 1))
    axes = [F.when(F.col("l").isNull(), 0).otherwise(_bucket(F.col("l"), bits)), F.when(F.col("s").isNull(), 0).otherwise(_bucket(F.col("s"), bits)), weight, F.greatest(F.lit(0), F.least(place, F.lit(cells - 1)))]
    keys = ["curve", "text_crc32", "size", "doc_id"]
    placed = base.select("doc_id", "size", "text_crc32", *[a.cast("long").alias(f"_{i}") for i, a in enumerate(axes)])
    curved = with_hilbert_index(placed, [f"_{i}" for i in range(len(axes))], bits)
    parts = max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # The sampled ranges are used once: what was dealt where is written before it is counted.
    dealt = stage(curved.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()))
    part, within = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    counts = dealt.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    offsets = counts.select("part", before.alias("before"), F.sum("n").over(Window.partitionBy()).alias("total"))
    ranked = dealt.join(F.broadcast(offsets), part == F.col("part"))  # offsets: one row for each of the partitions
    ranked = ranked.select("doc_id", "size", "text_crc32", "curve", "total", (F.col("before") + within).alias("rank"))
    sharded = ranked.withColumn("shard", F.expr(f"((rank + 1) * {shards} - 1) div total"))
    slot = F.col("rank") - F.expr(f"(shard * total) div {shards}")
    return sharded.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve")
