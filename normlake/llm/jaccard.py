"""Near-duplicates of Jaccard similarity ``LEAST`` or more: SimHash links of operator 2, and what they miss.

Operator 2's BK-trees link texts whose fingerprints differ in 4 bits or fewer, but two texts at a similarity of 0.8
differ in about 10 of 64 bits, so few such pairs come that way, and no tree finds the others without visiting nearly all
nodes. Further candidates come from ``BANDS`` hashes of ``ROWS`` minima each: texts with the same value in any of them
meet in a cell. A pair of similarity s is missed with probability (1 - s^ROWS)^BANDS, which is 5e-8 at s = 0.8. Each
candidate of either kind is judged by its texts' whole sets of shingles, so no link rests on an estimate.

Texts with equal sets are one node. First each node of a cell meets its next neighbours only; the links so found
join most large groups. Of the other cells, those that still hold several components get their nodes' sets
and are judged as wholes: an inverted index of the shingles counts what two sets share, and a spanning forest of the links
is what comes out. Cells are split into pairs of chunks by their number of shingles, so no task holds an unbounded group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .components import components
from .simhash import SEED, shingle_hashes
from .staging import join_on_hot, stage

#: The least similarity as a fraction of integers.
LEAST = (4, 5)
BANDS, ROWS = 32, 4
#: How far apart in its cell's order two nodes are compared at first.
REACH = 2
_RANDOM = np.random.default_rng(SEED)
_FACTORS, _TERMS = (_RANDOM.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted."""
    return np.unique(np.array(shingle_hashes(text or b"", width), np.uint64))


def set_id(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED)


def bands(hashes: np.ndarray) -> np.ndarray:
    """One hash of each band's minima; texts without words have no band."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 128):
        mixed = hashes[at : at + 128, None] * _FACTORS + _TERMS
        least = np.minimum(least, ((mixed ^ (mixed >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)).min(axis=0))
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(least.reshape(BANDS, ROWS))], np.uint64)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets' Jaccard similarity is ``LEAST`` or more."""
    num, den = LEAST
    if min(len(a), len(b)) * den < max(len(a), len(b)) * num:
        return False
    common = len(a) + len(b) - len(np.union1d(a, b))
    return common * (den + num) >= num * (len(a) + len(b))


def sign(docs: DataFrame, width: int, text: str, doc_id: str) -> DataFrame:
    """``doc_id, set_id, n, fp, bands`` of every row."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("_text"))

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, prints, keys = [], [], [], []
            for value in batch.column(1):  # one text's hashes at a time
                hashes = shingle_hashes(value.as_py() or b"", width)
                own = np.unique(np.array(hashes, np.uint64))
                ids.append(set_id(own))
                sizes.append(len(own))
                prints.append(simhash.fingerprint(hashes))
                keys.append(bands(own).view(np.int64))
            numbers = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (ids, prints)]
            yield pa.RecordBatch.from_arrays([batch.column(0), numbers[0], pa.array(sizes, pa.int64()), numbers[1], pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "set_id", "n", "fp", "bands"])

    return rows.mapInArrow(signed, "doc_id long, set_id long, n long, fp long, bands array<long>")


def with_set_id(docs: DataFrame, width: int, text: str = "text") -> DataFrame:
    """``docs`` and its rows' ``_set_id``."""
    rows = docs.withColumn("_bytes", F.col(text).cast("binary"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + ", _set_id long"

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.array([set_id(shingle_set(t.as_py(), width)) for t in batch.column(batch.num_columns - 1)], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(ids.view(np.int64))], [*batch.schema.names[:-1], "_set_id"])

    return rows.mapInArrow(named, schema)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each (key, cell) from batches sorted by them; a run may cross batches."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        rest = table if rest is None else pa.concat_tables([rest, table])
        key, cell = (rest.column(i).to_numpy() for i in (0, 1))
        edges = np.flatnonzero((key[1:] != key[:-1]) | (cell[1:] != cell[:-1])) + 1
        for i, j in zip([0, *edges.tolist()], edges.tolist()):
            yield rest.slice(i, j - i)
        if len(edges):
            rest = rest.slice(int(edges[-1]))
    if rest is not None and len(rest):
        yield rest


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of nodes that are at most ``REACH`` places apart in their cell's order by size and may be similar, wherever batches end."""
    num, den = LEAST
    tail = [np.zeros(0, np.int64)] * 3  # the rows before a batch that its first ones can reach
    for batch in batches:
        key, n, node = (np.concatenate([t, batch.column(i).to_numpy()]) for i, t in enumerate(tail))
        old = len(tail[0])
        for step in range(1, min(REACH, max(len(key) - 1, 0)) + 1):
            first = max(old - step, 0)  # pairs of rows before this batch came with theirs
            near = np.flatnonzero((key[first + step :] == key[first:-step]) & (n[first + step :] * num <= n[first:-step] * den)) + first
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[near], node[near + step])), pa.array(np.maximum(node[near], node[near + step]))], ["a", "b"])
        tail = [key[-REACH:], n[-REACH:], node[-REACH:]]


def cell_links(sets: list[np.ndarray], label: np.ndarray, side: np.ndarray) -> list[tuple[int, int]]:
    """Places of a spanning forest of the similar pairs of a cell whose sets come in order of size, beyond what ``label`` joins.

    Sides 1 and 2 are two chunks of a split cell: only pairs across them count; side 0 is one chunk.
    """
    num, den = LEAST
    size, label, out = np.array([len(s) for s in sets]), label.copy(), []
    if not size.sum():
        return out
    _, shingle = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(shingle, kind="stable")
    held, starts = owner[order], np.searchsorted(shingle[order], np.arange(shingle.max() + 2))
    begin = np.cumsum(size) - size
    for i in range(len(sets) - 1):
        last = int(np.searchsorted(size, size[i] * den // num, "right"))
        open_ = np.flatnonzero((label[i + 1 : last] != label[i]) & ((side[i + 1 : last] == 0) | (side[i + 1 : last] != side[i]))) + i + 1
        if not len(open_):
            continue
        own = shingle[begin[i] : begin[i] + size[i]]
        common = np.bincount(np.concatenate([held[starts[k] : starts[k + 1]] for k in own.tolist()]), minlength=len(sets))[open_]
        for j in open_[common * (den + num) >= num * (size[i] + size[open_])].tolist():
            if label[j] != label[i]:
                out.append((i, j))
                label[label == label[j]] = label[i]
    return out


def _forests(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Links of each cell, from rows (key, cell, n, node, root, side, text) sorted by key, cell, n."""
    for rows in _runs(batches):
        node, root, side = (rows.column(i).to_numpy() for i in (3, 4, 5))
        if len(node) < 2 or (root == root[0]).all():
            continue
        found = cell_links([shingle_set(t.as_py(), width) for t in rows.column(6)], root, side)
        if found:
            places = np.array(found)
            yield pa.RecordBatch.from_arrays([pa.array(node[places[:, 0]]), pa.array(node[places[:, 1]])], ["a", "b"])


def _verified(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """The pairs whose texts are similar."""
    one, two = (texts.select(F.col("set_id").alias(x), F.col("text").alias(f"t{x}")) for x in "ab")
    rows = pairs.join(one, "a").join(two, "b").select("a", "b", "ta", "tb")

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stay = [similar(shingle_set(x.as_py(), width), shingle_set(y.as_py(), width)) for x, y in zip(batch.column(2), batch.column(3))]
            yield batch.select(["a", "b"]).filter(pa.array(stay, pa.bool_()))

    return rows.mapInArrow(judged, "a long, b long")


def _simhash_pairs(signed: DataFrame) -> DataFrame:
    """Pairs of nodes that operator 2 links: equal fingerprints, and those its BK-trees find within the radius."""
    held = stage(signed.groupBy("fp", "set_id").agg(F.first("n").alias("n")))
    prints = stage(held.groupBy("fp").agg(F.min("set_id").alias("node"), F.count("*").alias("n")))
    same = join_on_hot(held.select("fp", "set_id"), prints.select("fp", "node"), "fp", prints.select("fp", "n")).select(F.col("set_id").alias("a"), F.col("node").alias("b"))
    one, two = (prints.select(F.col("fp").alias(x), F.col("node").alias(f"n{x}")) for x in "ab")
    trees = simhash.links(prints.select("fp")).join(one, "a").join(two, "b").select(F.col("na").alias("a"), F.col("nb").alias("b"))
    both = same.unionByName(trees)
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b")


def near_duplicates(docs: DataFrame, width: int = 5, text: str = "text", doc_id: str = "doc_id", most_shingles: int = 1 << 20) -> DataFrame:
    """``doc_id, set_id, root`` of every row; near-duplicates, directly or by way of others, share their ``root``.

    Defined results: texts without words are alike; rows with equal ids are rows of their own; an
    empty table gives no rows. Other columns aren't read.
    """
    signed = stage(sign(docs, width, text, doc_id))
    nodes = signed.groupBy("set_id").agg(F.first("n").alias("n"), F.first("bands").alias("bands"), F.count("*").alias("rows"))
    nodes = stage(nodes)
    keyed = stage(nodes.select("set_id", "n", F.explode("bands").alias("key")))
    met = keyed.groupBy("key").agg(F.count("*").alias("m"), F.sum("n").alias("total")).where("m > 1")
    cells = stage(keyed.join(met, "key"))
    alike = stage(_simhash_pairs(signed))
    needed = cells.select("set_id").unionByName(alike.select(F.explode(F.array("a", "b")).alias("set_id"))).distinct()
    texts = with_set_id(docs.select(F.col(text).cast("binary").alias("text")), width).join(needed.withColumnRenamed("set_id", "_set_id"), "_set_id", "left_semi")
    texts = stage(texts.groupBy(F.col("_set_id").alias("set_id")).agg(F.first("text").alias("text")))
    dealt = cells.select("key", "n", "set_id").repartition("key").sortWithinPartitions("key", "n", "set_id")
    pairs = stage(dealt.mapInArrow(_neighbours, "a long, b long").unionByName(alike).distinct())
    found = stage(_verified(pairs, texts, width))
    roots = stage(components(found))
    # A cell of up to REACH + 1 nodes has been compared as a whole.
    rows = cells.where(F.col("m") > REACH + 1).join(roots, cells["set_id"] == roots["node"], "left").select("key", "n", "m", "total", "set_id", F.coalesce("root", "set_id").alias("root"))
    several = rows.groupBy("key").agg((F.min("root") < F.max("root")).alias("open")).where("open").select("key")
    rows = rows.join(several, "key", "left_semi").withColumn("s", F.ceil(F.col("total") / most_shingles).cast("long")).withColumn("x", F.pmod(F.xxhash64("set_id"), F.col("s")))
    rows = rows.withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), F.col("s") - 1)))
    cell = F.least("x", "y") * F.col("s") + F.greatest("x", "y")
    side = F.when(F.col("x") == F.col("y"), 0).when(F.col("x") < F.col("y"), 1).otherwise(2).cast("long")
    whole = rows.select("key", cell.alias("cell"), "n", "set_id", "root", side.alias("side")).join(texts, "set_id").select("key", "cell", "n", "set_id", "root", "side", "text")
    dealt = whole.repartition("key", "cell").sortWithinPartitions("key", "cell", "n", "set_id")
    more = stage(dealt.mapInArrow(lambda batches: _forests(batches, width), "a long, b long").distinct())
    if not more.isEmpty():
        roots = stage(components(found.unionByName(more)))
    named = stage(nodes.join(roots, nodes["set_id"] == roots["node"], "left").select("set_id", F.coalesce("root", "set_id").alias("root")))
    return join_on_hot(signed.select("doc_id", "set_id"), named, "set_id", nodes.select("set_id", F.col("rows").alias("n"))).select("doc_id", "set_id", "root")
