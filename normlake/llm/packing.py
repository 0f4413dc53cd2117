"""Operator 5, best-fit packing by hierarchical residual packing.

Documents become token sequences with an end mark; only one longer than ``capacity`` is cut, into pieces of
which the first may be shorter, so at most one piece of a document is not full by itself. Each
partition packs its pieces by best fit, longest first, and emits nearly full bins. Underfull bins
travel up a tree as items: each node packs the bins of ``fan_in`` children by best fit again.

Best fit leaves at most one bin of half the capacity or less in a partition, and two bins above it can never
merge. So of a node's bins only the ``carry`` emptiest go on (many more than a node has children);
the others stand as they are. No node, the root included, holds more than fan_in x carry bins.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textarrays as ta
from .staging import stage
from .tokens import ByteBPE


@dataclass(frozen=True)
class PackParams:
    """A bin with at most ``slack`` free tokens is nearly full; ``leaf`` is about how many pieces a leaf packs."""

    capacity: int = 2048
    slack: int = 8
    fan_in: int = 8
    carry: int = 2048
    leaf: int = 20_000
    end_id: int = 0


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of item indices: longest item first, each into the fullest bin that has room."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # open bins by free tokens
    open_rooms, bins = 0, []  # bit r of open_rooms: some bin has r free tokens
    for item in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        size = sizes[item]
        fitting = open_rooms >> size
        if fitting:
            free = size + ((fitting & -fitting).bit_length() - 1)
            at = room[free].pop()
            if not room[free]:
                open_rooms &= ~(1 << free)
            bins[at].append(item)
        else:
            free, at = capacity, len(bins)
            bins.append([item])
        left = free - size
        if left:
            room[left].append(at)
            open_rooms |= 1 << left
    return bins


def pieces(docs: DataFrame, tokenizer: str, params: PackParams = PackParams(), text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: the pieces of every row, tokens themselves left out."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("_text"))
    capacity, end = params.capacity, np.array([params.end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ByteBPE.load(tokenizer)
        for batch in ta.parts(batches):
            out: list[list] = [[], [], [], [], []]
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encoder.encode_bytes(value or "") + end
                total = len(ids) // 4
                first = (total - 1) % capacity + 1
                for piece, start in enumerate([0, *range(first, total, capacity)]):
                    stop = first if piece == 0 else start + capacity
                    for column, x in zip(out, (doc, piece, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop]))):
                        column.append(x)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return rows.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def _pack(table: pa.Table, params: PackParams, last: bool) -> pa.Table:
    """Pack a node's items (``item``: its number, ``size``): each gets its bin and place in it."""
    node = table.column("node")[0].as_py()
    order = np.lexsort((table.column("item").to_numpy(),))
    item, size = table.column("item").to_numpy()[order], table.column("size").to_numpy()[order]
    bins = best_fit(size.tolist(), params.capacity)
    fill = np.array([size[b].sum() for b in bins])
    ranked = np.argsort(fill, kind="stable")
    carried = np.zeros(len(bins), bool)
    if not last:
        carried[ranked[: params.carry]] = True
        carried &= fill < params.capacity - params.slack
    at = np.concatenate([np.array(b) for b in bins])
    of = np.repeat(np.arange(len(bins)), [len(b) for b in bins])
    offset = np.concatenate([np.cumsum(size[b]) - size[b] for b in bins])
    return pa.table({"node": np.full(len(at), node, np.int64), "item": item[at], "bin": (node << 32) + of, "offset": offset.astype(np.int64), "fill": fill[of].astype(np.int64), "carried": carried[of]})


def _packer(params: PackParams, last: bool) -> Callable[[pa.Table], pa.Table]:
    return lambda table: _pack(table, params, last)


def pack(found: DataFrame, params: PackParams = PackParams()) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows that have a ``length`` of 1 to the capacity."""
    schema = "node long, item long, bin long, offset long, fill long, carried boolean"
    named = stage(found.withColumn("item", F.monotonically_increasing_id()))
    count = named.where(F.col("length") < params.capacity).count()
    leaves = max(1, -(-count // params.leaf))
    whole = named.where(F.col("length") >= params.capacity).select("item", (-F.col("item") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    part = named.where(F.col("length") < params.capacity).select("item", F.col("length").alias("size"), F.pmod(F.xxhash64("item"), F.lit(leaves)).alias("node"))
    placed, nodes, level = [], leaves, 0
    items, levels = part, []
    while True:
        last = nodes == 1
        packed = stage(items.groupBy("node").applyInArrow(_packer(params, last), schema).withColumn("bin", F.col("bin") + (level << 56)))
        levels.append(packed)
        if last:
            break
        bins = packed.where("carried").groupBy("bin", "node").agg(F.max("fill").alias("size"))
        items = bins.select(F.col("bin").alias("item"), "size", F.expr(f"node div {params.fan_in}").alias("node"))
        nodes, level = -(-nodes // params.fan_in), level + 1
    settled = levels[0].select("item", "bin", "offset", "carried")
    for above in levels[1:]:
        up = above.select(F.col("item").alias("bin"), F.col("bin").alias("up_bin"), F.col("offset").alias("up_offset"), F.col("carried").alias("up_carried"))
        moved = settled.where("carried").join(up, "bin").select("item", F.col("up_bin").alias("bin"), (F.col("offset") + F.col("up_offset")).alias("offset"), F.col("up_carried").alias("carried"))
        placed.append(settled.where("not carried"))
        settled = moved
    for early in placed:
        settled = settled.unionByName(early)
    places = settled.select("item", F.col("bin").alias("sequence_id"), "offset").unionByName(whole)
    return named.join(places, "item").drop("item")


def pack_documents(docs: DataFrame, tokenizer: str, params: PackParams = PackParams(), text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece.

    Defined results: a null or empty text is one piece that holds the end mark; repeated rows are
    packed each time they stand, a null id stays null; an empty table gives no rows. Other columns aren't read.
    """
    return pack(pieces(docs, tokenizer, params, text, doc_id), params)
