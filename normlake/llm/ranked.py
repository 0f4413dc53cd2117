"""Ranked lexical search: accumulator-limited term-at-a-time evaluation of a stated query set, exact in integers.

One pass over the texts counts each document's terms and keeps the query terms' frequencies (Arrow batches, nothing is shuffled); numbers of
documents, of terms and the queries' document frequencies are aggregates of that table. Then every task walks its own documents in
blocks of bounded size. For one query it takes the terms rarest first. As long as the bounds of this and later terms reach the kth best
score known so far (finished documents of the task's earlier blocks, partial scores of this one) a posting may create an accumulator;
after that no new document can come among the first k, and later terms only update the accumulators there are, exactly. A task ends with at
most k rows for each query, and the first k of all tasks are ranked.

A null text has no terms and is never found; a null id comes before all others among equal scores. Repeated rows are documents of their own, repeated
items queries of their own. No documents or no items give no rows. Other columns play no part. Texts are taken whole; one document's distinct query terms are held
at a time, and a block's postings.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .staging import stage

#: Query sets are run in blocks of so many items and characters at most, so that what each task is sent has a bound.
MOST_ITEMS, MOST_CHARS = 4096, 8 << 20
#: Postings in a block of documents.
POSTINGS = 1 << 21
_NULL = np.iinfo(np.int64).min
_SEPARATORS = re.compile(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
#: Bytes of ASCII that separate terms become spaces, A to Z become a to z; all bytes of other characters belong to terms.
_TABLE = bytes(32 if b < 128 and _SEPARATORS.match(chr(b)) else b + 32 if 65 <= b <= 90 else b for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """The maximal runs of letters and digits of ASCII and of all other characters; only A to Z are lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


@dataclass
class Queries:
    """A block of items: their terms by number, rarest first, how often each counts, and what its weight and bound are."""

    items: list
    numbers: dict[bytes, int]
    counts: list[Counter]
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    frequencies: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    bounds: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))


def item_blocks(items: DataFrame) -> Iterator[Queries]:
    """The items (``item_id, text``) in blocks with proven bounds; an item that is longer alone is a block of its own."""
    row = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    blocks = max(-(-row["n"] // (MOST_ITEMS // 2)), -(-row["chars"] // (MOST_CHARS // 2)))
    dealt = items.select("item_id", "text", F.pmod(F.xxhash64("item_id", "text"), F.lit(max(blocks, 1))).alias("block"))
    for block in range(blocks):
        held: list[tuple] = []
        chars = 0
        for r in dealt.where(F.col("block") == block).toLocalIterator():
            if held and (len(held) >= MOST_ITEMS or chars + len(r["text"] or "") > MOST_CHARS):
                yield _queries(held)
                held, chars = [], 0
            held.append((r["item_id"], terms(r["text"])))
            chars += len(r["text"] or "")
        if held:
            yield _queries(held)


def _queries(held: list[tuple]) -> Queries:
    numbers: dict[bytes, int] = {}
    for _, own in held:
        for t in own:
            numbers.setdefault(t, len(numbers))
    return Queries([i for i, _ in held], numbers, [Counter(numbers[t] for t in own) for _, own in held])


def frequencies(docs: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """``doc_id, n, terms, tfs`` of each document with a term: its number of terms, and the query terms in it with their frequencies."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int64()))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = terms(text.as_py())
                if words:
                    found = Counter(map(numbers.get, words))
                    found.pop(None, None)
                    rows.append((doc_id, len(words), list(found.keys()), list(found.values())))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], schema.field(i).type) for i in range(4)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(count, "doc_id long, n long, terms array<int>, tfs array<long>")


def with_statistics(queries: Queries, counted: DataFrame) -> tuple[int, int]:
    """Set the queries' weights, document frequencies and bounds from all documents; returns N and L."""
    row = counted.agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("l")).first()
    n, length = row["n"], row["l"]
    size = len(queries.numbers)
    queries.weights, queries.frequencies, queries.bounds = (np.zeros(size, np.int64) for _ in range(3))
    if n:
        each = counted.select("n", F.explode(F.arrays_zip("terms", "tfs")).alias("x")).select("n", F.col("x.terms").alias("term"), F.col("x.tfs").alias("tf"))
        impact = each.select("term", F.expr(f"(1000000000L * tf) div (1000L * tf + 12L * (75L + (25L * n * {n}L) div {length}L))").alias("impact"))
        weight = F.floor(1000 * F.log(F.lit(2 * n + 2) / (2 * F.col("df") + 1)))
        by_term = impact.groupBy("term").agg(F.count("*").alias("df"), F.max("impact").alias("most"))  # a row for each of the block's terms at most
        for r in by_term.select("term", "df", "most", weight.alias("w")).toLocalIterator():
            queries.weights[r["term"]], queries.frequencies[r["term"]], queries.bounds[r["term"]] = r["w"], r["df"], r["w"] * r["most"]
    return n, length


class Evaluator:
    """Term-at-a-time over blocks of documents; keeps the k best (score, then id) of each query."""

    def __init__(self, queries: Queries, n: int, length: int, k: int) -> None:
        self.k, self.n, self.length, self.weights = k, n, length, queries.weights
        self.best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in queries.items]
        self.plans = []
        for counts in queries.counts:
            order = sorted((t for t in counts if queries.weights[t] > 0), key=lambda t: (queries.frequencies[t], t))
            times = np.array([counts[t] for t in order], np.int64)
            rest = np.cumsum((queries.bounds[order] * times)[::-1])[::-1] if order else np.zeros(0, np.int64)
            self.plans.append((order, times, rest))
        self.created = self.postings = 0

    def block(self, ids: np.ndarray, lengths: np.ndarray, sizes: np.ndarray, found: np.ndarray, tfs: np.ndarray) -> None:
        """Take in documents (ids, lengths) whose query terms follow each other in ``found``, ``sizes`` of each."""
        norms = 75 + (25 * lengths * self.n) // self.length
        rows = np.repeat(np.arange(len(ids)), sizes)
        order = np.argsort(found, kind="stable")
        found, rows, tfs = found[order], rows[order], tfs[order]
        gains = self.weights[found] * ((1_000_000_000 * tfs) // (1000 * tfs + 12 * norms[rows]))
        starts = np.searchsorted(found, np.arange(len(self.weights) + 1))
        scores = np.zeros(len(ids), np.int64)
        for q, (terms_, times, rest) in enumerate(self.plans):
            held, before = self.best[q], np.zeros(0, np.int64)
            touched = [before]
            least, creating = (held[0][-1] if len(held[0]) == self.k else 0), True
            for t, count, bound in zip(terms_, times, rest):
                here = slice(starts[t], starts[t + 1])
                docs, gain = rows[here], gains[here] * count
                self.postings += len(docs)
                if creating and bound < least:
                    creating = False
                if not creating:
                    there = scores[docs] > 0
                    docs, gain = docs[there], gain[there]
                    scores[docs] += gain
                    continue
                new = docs[(scores[docs] == 0) & (gain > 0)]
                self.created += len(new)
                scores[docs] += gain
                touched.append(new)
                least = max(least, self._kth(scores, touched, held[0]))
            candidates = np.concatenate(touched)
            if len(candidates):
                self._keep(q, scores[candidates], ids[candidates])
                scores[candidates] = 0

    def _kth(self, scores: np.ndarray, touched: list[np.ndarray], held: np.ndarray) -> int:
        """The kth best of this block's partial scores and the earlier blocks' final ones; 0 if there are fewer."""
        docs = np.concatenate(touched)
        touched[:] = [docs]
        known = np.concatenate([held, scores[docs]])
        return int(np.partition(known, len(known) - self.k)[len(known) - self.k]) if len(known) >= self.k else 0

    def _keep(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.best[q][0], scores]), np.concatenate([self.best[q][1], ids])
        if len(scores) > 4 * self.k:
            enough = scores >= np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            scores, ids = scores[enough], ids[enough]
        order = np.lexsort((ids, -scores))[: self.k]
        self.best[q] = scores[order], ids[order]


def search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's ``k`` best documents with a score above 0, equal scores by id."""
    empty = docs.sparkSession.createDataFrame([], "_item long, item_id long, rank int, doc_id long, score long").drop("_item")
    found = [_block(docs, queries, k) for queries in item_blocks(items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")))]
    for part in found:
        empty = empty.unionByName(part)
    return empty


def _block(docs: DataFrame, queries: Queries, k: int) -> DataFrame:
    counted = stage(frequencies(docs, queries.numbers))
    n, length = with_statistics(queries, counted)
    queries.numbers = {}  # tasks need the numbers alone
    if not n:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")

    def evaluate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, waiting, size = Evaluator(queries, n, length, k), [], 0
        for batch in batches:
            waiting.append(batch)
            size += len(batch.column(2).flatten()) + batch.num_rows
            if size >= POSTINGS:
                _take(own, waiting)
                waiting, size = [], 0
        _take(own, waiting)
        rows = [(q, queries.items[q], d, s) for q, (scores, ids) in enumerate(own.best) for s, d in zip(scores.tolist(), ids.tolist())]
        columns = [[r[0] for r in rows], [r[1] for r in rows], [None if r[2] == _NULL else r[2] for r in rows], [r[3] for r in rows]]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["_item", "item_id", "doc_id", "score"])

    each = counted.where(F.size("terms") > 0).mapInArrow(evaluate, "_item long, item_id long, doc_id long, score long")
    place = F.row_number().over(Window.partitionBy("_item").orderBy(F.desc("score"), "doc_id"))
    return each.withColumn("rank", place).where(F.col("rank") <= k).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def _take(own: Evaluator, batches: list[pa.RecordBatch]) -> None:
    if batches:
        table = pa.Table.from_batches(batches).combine_chunks()
        column = lambda name: table.column(name).combine_chunks()
        lists = column("terms")
        sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        own.block(column("doc_id").fill_null(_NULL).to_numpy(), column("n").to_numpy(), sizes, lists.flatten().to_numpy(), column("tfs").flatten().to_numpy())
