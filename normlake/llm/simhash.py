"""Operator 2, SimHash near-dedup by BK-trees.

Fingerprints: the shingles of a text vote on 64 bits. Links: two fingerprints that differ in at most
``radius`` = 4 bits, cut into ``BLOCKS`` = 6 blocks, agree on at least two whole blocks, so they meet in
one of 15 shards, each named by a pair of blocks and their bits. Each shard's fingerprints form a
BK-tree (children keyed by integer Hamming distance to the parent), and a query follows only the
edges within the radius. All shards together are as large as the corpus, so trees aren't broadcast
to every executor: a shard's tree is built where that shard's queries are, and every link comes from a search in one. A shard of more than
``most_in_tree`` fingerprints is split into trees of that size, each copied to all chunks of queries
of its shard, so no task holds an unbounded group.

Equal fingerprints meet first (one row each is linked), and a tree reports a spanning forest of the links in it,
not all pairs; components then join the forests.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .staging import join_on_hot, stage

SEED = 42
RADIUS = 4
#: First bit and width of each block.
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
_LANES = np.array([sum(((x >> j) & 1) << (8 * j) for j in range(8)) for x in range(256)], np.uint64)


def shingle_hashes(text: bytes, width: int) -> list[int]:
    """XXH64 of each run of ``width`` words, A-Z lower-cased; of all words if there are fewer; none without words."""
    words = text.lower().split()
    if not words:
        return []
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return [digest(joined, SEED)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    firsts = np.concatenate(([0], ends[:-1]))[: len(words) - width + 1].tolist()
    lasts = (ends[width - 1 :] - 1).tolist()
    return [digest(joined[a:b], SEED) for a, b in zip(firsts, lasts)]


def fingerprint(hashes: list[int]) -> int:
    """A bit is set if it is set in over half the hashes; zero without any."""
    if not hashes:
        return 0
    lanes = _LANES[np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8)]
    parts = np.add.reduceat(lanes, np.arange(0, len(lanes), 255), axis=0)  # 8 bit counts of a byte each in every number
    counts = parts.view(np.uint8).reshape(len(parts), 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * counts > len(hashes)).astype(np.uint8), bitorder="little").view(np.uint64)[0])


def fingerprints(texts: list[bytes | None], width: int = 4) -> np.ndarray:
    """The unsigned 64-bit fingerprint of each text."""
    return np.array([fingerprint(shingle_hashes(text or b"", width)) for text in texts], np.uint64)


def sign(docs: DataFrame, width: int = 4, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, fp`` (the fingerprint as a signed long) of every row; a null text has no words."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("_text"))

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = fingerprints(batch.column(1).to_pylist(), width)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64), pa.int64())], ["doc_id", "fp"])

    return rows.mapInArrow(signed, "doc_id long, fp long")


class BKTree:
    """A metric tree over integers under Hamming distance."""

    def __init__(self) -> None:
        self.root: list | None = None

    def add(self, value: int) -> None:
        if self.root is None:
            self.root = [value, {}]
            return
        node = self.root
        while True:
            distance = (node[0] ^ value).bit_count()
            below = node[1].get(distance)
            if below is None:
                node[1][distance] = [value, {}]
                return
            node = below

    def within(self, value: int, radius: int) -> Iterator[int]:
        """The values at ``radius`` or less; only edges from distance - radius to distance + radius are followed."""
        if self.root is None:
            return
        open_nodes = [self.root]
        while open_nodes:
            at, children = open_nodes.pop()
            distance = (at ^ value).bit_count()
            if distance <= radius:
                yield at
            if children:
                low, high = distance - radius, distance + radius
                if len(children) == 1:
                    open_nodes += [c for d, c in children.items() if low <= d <= high]
                else:
                    open_nodes += [children[d] for d in range(low, high + 1) if d in children]


def tree_links(values: list[int], sides: list[int], radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between a tree's values (side 0 or 1) and its queries (0 or 2)."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while parent.get(x, x) != x:
            parent[x] = x = parent.get(parent[x], parent[x])
        return x

    tree, links, waiting = BKTree(), [], [v for v, s in zip(values, sides) if s == 2]

    def link(value: int) -> None:
        for other in tree.within(value, radius):
            a, b = top(value), top(other)
            if a != b:
                parent[max(a, b)] = min(a, b)
                links.append((value, other))

    for value, side in zip(values, sides):
        if side == 0:
            link(value)
        if side < 2:
            tree.add(value)
    for value in waiting:
        link(value)
    return links


def _runs(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Links of each run of equal (key, cell) in rows sorted by them; a run may cross batches."""
    rest = [np.zeros(0, np.int64) for _ in range(4)]

    def linked(cols: list[np.ndarray]) -> pa.RecordBatch:
        key, cell, fp, side = cols
        edges = np.flatnonzero((key[1:] != key[:-1]) | (cell[1:] != cell[:-1])) + 1
        firsts, lasts = np.concatenate(([0], edges)), np.concatenate((edges, [len(key)]))
        unsigned = fp.view(np.uint64)
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, j in zip(firsts[lasts - firsts > 1].tolist(), lasts[lasts - firsts > 1].tolist()):
            if found := tree_links(unsigned[i:j].tolist(), side[i:j].tolist(), radius):
                pairs = np.array(found, np.uint64).view(np.int64)
                a.append(pairs[:, 0])
                b.append(pairs[:, 1])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    for batch in batches:
        cols = [np.concatenate((r, c.to_numpy(zero_copy_only=False).astype(np.int64))) for r, c in zip(rest, batch.columns)]
        if not len(cols[0]):
            continue
        last = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1])
        cut = len(last) - int(last.sum())
        rest = [c[cut:] for c in cols]
        if cut:
            yield linked([c[:cut] for c in cols])
    if len(rest[0]):
        yield linked(rest)


def links(prints: DataFrame, radius: int = RADIUS, most_in_tree: int = 4096) -> DataFrame:
    """``a, b``: a spanning forest of the links between the distinct fingerprints ``fp``.

    ``radius`` may be at most 4, the number of blocks less two.
    """
    if radius > len(BLOCKS) - 2:
        raise ValueError(f"radius {radius}: six blocks find all links up to {len(BLOCKS) - 2} bits")
    block = [F.shiftrightunsigned(F.col("fp"), at).bitwiseAND((1 << width) - 1) for at, width in BLOCKS]
    pairs = [(i, j) for i in range(len(block)) for j in range(i)]
    names = [(F.lit(k << 32) + F.shiftleft(block[i], 12) + block[j]) for k, (i, j) in enumerate(pairs)]
    keyed = prints.select("fp", F.explode(F.array(*names)).alias("key"))
    met = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shards = F.ceil(F.col("n") / most_in_tree).cast("long")
    rows = keyed.join(met, "key").withColumn("s", shards).withColumn("x", F.pmod(F.xxhash64("fp"), F.col("s")))
    rows = rows.withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), F.col("s") - 1)))
    cell = F.least("x", "y") * F.col("s") + F.greatest("x", "y")
    side = F.when(F.col("x") == F.col("y"), 0).when(F.col("x") < F.col("y"), 1).otherwise(2).cast("long")
    celled = rows.select("key", cell.alias("cell"), "fp", side.alias("side"))
    dealt = celled.repartition("key", "cell").sortWithinPartitions("key", "cell", "fp")
    return dealt.mapInArrow(lambda batches: _runs(batches, radius), "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 4, radius: int = RADIUS, text: str = "text", doc_id: str = "doc_id", most_in_tree: int = 4096) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row.

    Defined results: a null or empty text has fingerprint zero and links like any other; rows with
    equal ids are rows of their own, with their own texts' fingerprints; a null id stays null and its row
    links, but a component's id is its least non-null id (null if there is none); an empty table
    gives no rows. Other columns aren't read.
    """
    signed = stage(sign(docs, width, text, doc_id))
    prints = stage(signed.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("n")))
    roots = stage(components(links(prints, radius, most_in_tree)))
    linked = stage(prints.join(roots.withColumnRenamed("node", "fp"), "fp").select("fp", "root", "least_id"))
    least = linked.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count("*").alias("n"))
    named = join_on_hot(linked.select("fp", "root"), least.select("root", "component_id"), "root", least.select("root", "n"))
    classes = stage(prints.join(named.select("fp", "component_id"), "fp", "left").select("fp", F.coalesce("component_id", "least_id").alias("component_id")))
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return join_on_hot(signed, classes, "fp", prints.select("fp", "n")).select("doc_id", hexed.alias("fingerprint"), "component_id")
