"""Operator 7, embedding near-dedup: an exact metric range join over pivots' cells.

Vectors are scaled to length 1, so that cosine >= ``threshold`` means a Euclidean distance of at most
``eps`` = sqrt(2 - 2 threshold). Each vector is at home in the cell of its nearest pivot. A cell of more than ``most`` vectors is
parted by their distance to the pivot; small cells share a part. For each part the least and the greatest distance to every pivot are known; by the
triangle inequality two parts can hold vectors within ``eps`` of each other only if these ranges lie within ``eps`` for all
pivots. Each part is copied to those it may reach, and each pair of parts is compared once, independently of all others.

Equal vectors are joined once, with their multiplicity. Pivots are a bounded sample whose number grows with the root of
the number of vectors; they steer the work, not the result. Parts grow once there would be more than ``most_parts``, so that the table of
their pairs stays small.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .staging import join_on_hot, stage

#: Ranges of distance that a cell can be parted into.
BANDS = 64


@dataclass(frozen=True)
class JoinParams:
    """From ``pivots`` to ``most_pivots`` pivots; ``most`` vectors of a part, ``most_parts`` parts."""

    threshold: float = 0.95
    pivots: int = 24
    most_pivots: int = 256
    most: int = 8192
    most_parts: int = 4096


def _clean(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """``vec_id, v`` (doubles; null where the vector can't be compared)."""
    v = F.col(embedding).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | ~F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.when(v.isNull() | bad, None).otherwise(v).alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * (x @ pivots.T)))


def _by_size(batch: pa.RecordBatch, column: int) -> Iterator[tuple[np.ndarray, pa.RecordBatch]]:
    """Rows of ``batch`` in groups of vectors of one length, as unit vectors."""
    sizes = pc.list_value_length(batch.column(column)).to_numpy(zero_copy_only=False)
    for size in np.unique(sizes):
        part = batch.filter(pa.array(sizes == size))
        yield _unit(_matrix(part.column(column))), part


def _forest(similar: np.ndarray, home: np.ndarray, other: np.ndarray) -> tuple[list[int], list[int]]:
    """Links (home, other) that connect all that ``similar`` connects."""
    names, index = np.unique(np.concatenate((home, other)), return_inverse=True)
    label, left, right = np.arange(len(names)), [], []
    rows, cols = np.nonzero(similar)
    cuts = np.flatnonzero(np.diff(rows)) + 1
    for own, near in zip(rows[np.concatenate(([0], cuts))] if len(rows) else [], np.split(cols, cuts)):
        mine, theirs = index[own], index[len(home) + near]
        labels, first = np.unique(label[theirs], return_index=True)
        new = labels != label[mine]
        if new.any():
            left += [int(names[mine])] * int(new.sum())
            right += names[theirs[first[new]]].tolist()
            label[np.isin(label, np.append(labels, label[mine]))] = min(labels.min(), label[mine])
    return left, right


def near_duplicates(vectors: DataFrame, params: JoinParams = JoinParams(), vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row.

    Defined results: a vector that is null, zero, or holds a null or non-finite component has no
    link and is kept; vectors of different lengths never link; equal vectors link (repeated rows count as other
    vectors); rows without an id link and count but can't name a component, and aren't kept;
    an empty table gives no rows. Other columns aren't read.
    """
    spark = vectors.sparkSession
    eps = float(np.sqrt(2 - 2 * params.threshold)) + 1e-9
    rows = stage(_clean(vectors, vec_id, embedding).withColumn("vh", F.when(F.col("v").isNotNull(), F.xxhash64("v"))))
    # One row for each distinct vector, named by a number of its own: equal hashes with unequal vectors stay apart.
    distinct = stage(rows.where("v is not null").groupBy("vh", "v").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least_id")).withColumn("node", F.monotonically_increasing_id()))
    total = distinct.count()
    most = max(params.most, -(-2 * total // params.most_parts))
    wanted = min(params.most_pivots, max(params.pivots, int(total**0.5) // 8))
    chosen = distinct.orderBy(F.xxhash64("vh"), "vh").select("v").limit(wanted).collect()  # most_pivots rows at most
    by_size: dict[int, np.ndarray] = {}
    for size in {len(r["v"]) for r in chosen}:
        by_size[size] = _unit(np.array([r["v"] for r in chosen if len(r["v"]) == size]))
    pivots = spark.sparkContext.broadcast(by_size)

    def _measured(x: np.ndarray) -> np.ndarray:
        """Distances to the pivots of the same length; a length without pivots has one that is as far from all."""
        known = pivots.value.get(x.shape[1])
        return np.zeros((len(x), 1)) if known is None else _distances(x, known)

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, _ in _by_size(batch, 0):
                d = _measured(x)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), x.shape[1], np.int64)), pa.array(d.argmin(axis=1).astype(np.int64)), pa.array(d.min(axis=1))], ["size", "cell", "far"])

    # At most one row for each pivot and each vector length without pivots.
    share = [k / BANDS for k in range(1, BANDS)]
    cells = distinct.select("v").mapInArrow(homes, "size long, cell long, far double").groupBy("size", "cell").agg(F.count("*").alias("n"), F.percentile_approx("far", share).alias("cuts")).collect()
    plan: dict[int, dict[int, tuple[int, np.ndarray, int]]] = {}

    def near_first(r) -> float:
        known = by_size.get(r["size"])
        return 0.0 if known is None else float(_distances(known[[r["cell"]]], known[:1])[0, 0])

    first, shared, room, size = 0, 0, 0, None
    for r in sorted(cells, key=lambda r: (r["size"], near_first(r), r["cell"])):
        if r["n"] <= room and r["size"] == size:  # small cells share a part
            plan[size][r["cell"]], room = (shared, np.zeros(0), 1), room - r["n"]
            continue
        parts = -(-r["n"] // most)
        bands = min(parts, BANDS)
        cuts = np.array(r["cuts"])[[round(k * BANDS / bands) - 1 for k in range(1, bands)]] if bands > 1 else np.zeros(0)
        deals = -(-parts // bands)  # by hash, where there aren't bands enough
        plan.setdefault(r["size"], {})[r["cell"]] = (first, cuts, deals)
        shared, room, size = first, most - r["n"] if parts == 1 else 0, r["size"]
        first += bands * deals
    known_plan = spark.sparkContext.broadcast(plan)

    def _parts(x: np.ndarray, d: np.ndarray, node: np.ndarray) -> np.ndarray:
        home, far, out = d.argmin(axis=1), d.min(axis=1), np.zeros(len(x), np.int64)
        for cell in np.unique(home):
            start, cuts, deals = known_plan.value[x.shape[1]][int(cell)]
            own = home == cell
            out[own] = start + np.searchsorted(cuts, far[own]) * deals + node[own] % deals
        return out

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, part in _by_size(batch, 1):
                d = _measured(x)
                at = _parts(x, d, part.column(0).to_numpy())
                for k in np.unique(at):
                    own, n = d[at == k], d.shape[1]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, k)), pa.array(np.full(n, x.shape[1], np.int64)), pa.array(np.arange(n)), pa.array(own.min(axis=0)), pa.array(own.max(axis=0))], ["part", "size", "pivot", "low", "high"])

    # Parts x pivots rows; most_parts and most_pivots bound them.
    spans = distinct.select("node", "v").mapInArrow(ranges, "part long, size long, pivot long, low double, high double").groupBy("part", "size", "pivot").agg(F.min("low").alias("low"), F.max("high").alias("high")).toPandas()
    partners: dict[int, np.ndarray] = {}
    for _, group in spans.groupby("size"):
        low, high = (group.pivot(index="part", columns="pivot", values=c) for c in ("low", "high"))
        names, low, high = low.index.to_numpy(), low.to_numpy(), high.to_numpy()
        for k, name in enumerate(names):
            gap = np.maximum(low - high[k], low[k] - high).max(axis=1)
            partners[int(name)] = names[gap <= eps]
    reach = spark.sparkContext.broadcast(partners)
    single = vectors.schema[embedding].dataType.elementType.typeName() == "float"
    kind, values = ("array<float>", pa.float32()) if single else ("array<double>", pa.float64())

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, rows_ in _by_size(batch, 1):
                own = _parts(x, _measured(x), rows_.column(0).to_numpy())
                raw = rows_.column(1).cast(pa.list_(values))  # a float's double is that float again
                for part in np.unique(own):
                    at = pa.array(np.flatnonzero(own == part))
                    node, copies, v = (c.take(at) for c in (rows_.column(0), rows_.column(2), raw))
                    for other in reach.value[int(part)].tolist():
                        ends = [pa.array(np.full(len(at), e)) for e in (min(part, other), max(part, other))]
                        yield pa.RecordBatch.from_arrays([*ends, pa.array(np.full(len(at), part > other)), node, copies, v], ["a", "b", "second", "node", "copies", "v"])

    threshold = params.threshold

    def joined(table: pa.Table) -> pa.Table:
        second = table.column("second").combine_chunks().to_numpy(zero_copy_only=False).astype(bool)
        node, weight = table.column("node").to_numpy(), table.column("copies").to_numpy().astype(np.float64)
        x = _unit(_matrix(table.column("v").combine_chunks()).astype(np.float64))
        order = np.argsort(node, kind="stable")
        one, two = order[~second[order]], order[second[order]]
        within = table.column("a")[0] == table.column("b")[0]
        two = one if within else two
        a, b, n, back = [], [], [], np.zeros(len(two))
        for at in range(0, len(one), 512):
            own = one[at : at + 512]
            similar = x[own] @ x[two].T >= threshold
            similar &= node[own][:, None] != node[two][None, :]
            totals = similar @ weight[two]
            back += weight[own] @ similar
            left, right = _forest(similar, node[own], node[two])
            a += [node[own][totals > 0], np.array(left, np.int64)]
            b += [node[own][totals > 0], np.array(right, np.int64)]
            n += [totals[totals > 0].astype(np.int64), np.zeros(len(left), np.int64)]
        if not within:
            for column, x_ in ((a, node[two][back > 0]), (b, node[two][back > 0]), (n, back[back > 0].astype(np.int64))):
                column.append(x_)
        empty = np.zeros(0, np.int64)
        return pa.table({"a": np.concatenate([empty, *a]), "b": np.concatenate([empty, *b]), "n": np.concatenate([empty, *n])})

    copies = distinct.select("node", "v", "copies").mapInArrow(placed, f"a long, b long, second boolean, node long, copies long, v {kind}")
    found = stage(copies.groupBy("a", "b").applyInArrow(joined, "a long, b long, n long"))
    counts = found.where("n > 0").groupBy("a").agg(F.sum("n").alias("linked")).withColumnRenamed("a", "node")
    roots = components(found.where("a <> b").select("a", "b")).withColumnRenamed("root", "r")
    classes = stage(distinct.drop("v").join(counts, "node", "left").join(roots, "node", "left").select("vh", "node", "copies", "least_id", F.coalesce("linked", F.lit(0)).alias("linked"), F.coalesce("r", "node").alias("r")))
    least = classes.groupBy("r").agg(F.min("least_id").alias("component_id"), F.count("*").alias("n"))
    joined_classes = join_on_hot(classes, least.select("r", "component_id"), "r", least.select("r", "n"))
    named = stage(joined_classes.select("vh", "node", (F.col("copies") - 1 + F.col("linked")).alias("n_links"), "component_id").join(distinct.select("node", "v"), "node").drop("node"))
    usable = rows.where("v is not null")
    # Equal hashes of unequal vectors are parted after the join, so the hash alone is its key.
    per_hash = named.groupBy("vh").agg(F.collect_list(F.struct("v", "n_links", "component_id")).alias("all"))
    met = join_on_hot(usable, per_hash, "vh", distinct.groupBy("vh").agg(F.sum("copies").alias("n")))
    own = F.get(F.filter("all", lambda x: x["v"] == F.col("v")), F.lit(0))
    linked = met.select("vec_id", own["n_links"].alias("n_links"), own["component_id"].alias("component_id"))
    alone = rows.where("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
