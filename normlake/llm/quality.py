"""Operator 1, quality classifier: learned hashed word and character n-gram vectors.

A document is the average of the vectors of its words, its word pairs and its character trigrams
and 4-grams, each hashed to one of ``buckets`` rows; a softmax layer over the average gives class
probabilities. Both layers are trained by numpy stochastic gradient descent on a sample of
labelled rows bounded by ``rows_per_class`` (documented below), on the driver.

Averaging and the output layer are both linear, so a trained model is folded into one logit per
bucket and class before it is broadcast: ``buckets`` x classes 4-byte numbers (2 MB as set here),
whatever the size of the corpus. Scoring is then one pass over the documents without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textarrays as ta

NGRAMS = (3, 4)


@dataclass(frozen=True)
class QualityParams:
    """``rows_per_class`` and ``max_chars`` bound the training sample: at most so many labelled rows
    of each class, lowest hashed ids first, none longer than ``max_chars`` characters."""

    buckets: int = 1 << 18
    dimensions: int = 16
    epochs: int = 10
    rate: float = 1.0
    rows_per_class: int = 1500
    max_chars: int = 60_000
    seed: int = 7


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """True for the rows whose id's CRC-32, as text, leaves ``fold``; a null id is held out too."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(True))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, rows_per_class: int, max_chars: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``text, y``: up to ``rows_per_class`` training rows for each of the labels 0 and 1.

    The ids are chosen from the labels alone; the broadcast side so has 2 x ``rows_per_class`` rows
    at most. Rows with null id, label or text, and labels other than 0 and 1, teach nothing; of an
    id with several labels the least counts, of one with several texts the alphabetically first.
    """
    usable = labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_y")).where(F.col("_id").isNotNull() & F.col("_y").isin(0, 1) & ~held_out(F.col("_id"), folds, fold))
    usable = usable.groupBy("_id").agg(F.min("_y").alias("_y"))
    chosen = [usable.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(rows_per_class) for y in (0, 1)]
    ids = chosen[0].unionByName(chosen[1])
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).where(F.length("_text") <= max_chars)
    return rows.join(F.broadcast(ids), "_id").groupBy("_id").agg(F.min("_text").alias("text"), F.min("_y").alias("y"))


def features(texts: list[str], buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each kind of feature, the bucket of each occurrence and each text's range in them."""
    points, starts, ends = ta.code_points(texts)
    for n in NGRAMS:
        hashes = ta.ngram_hashes(points, n) & np.uint32(buckets - 1)
        yield hashes, starts, np.maximum(starts, ends - (n - 1))
    first, last = ta.word_bounds(points)
    words, a, b = ta.word_hashes(points, first, last), np.searchsorted(first, starts), np.searchsorted(first, ends)
    # A word and itself are one kind of pair, whatever the word.
    pairs = np.where(words[:-1] == words[1:], np.uint64(1), ta.mix(words[:-1] + np.uint64(3) * words[1:])) if len(words) > 1 else words[:0]
    for hashes, n in ((words, 1), (pairs, 2)):
        yield (hashes >> np.uint64(20)).astype(np.uint32) & np.uint32(buckets - 1), a, np.maximum(a, b - (n - 1))


def train(texts: list[str], labels: list[int], params: QualityParams = QualityParams(), classes: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Logits by bucket and class, and the biases. Nothing to learn from gives a neutral model."""
    rows: list[tuple[np.ndarray, np.ndarray]] = []
    for _, chunk in ta.chunks(texts):
        parts = list(features(chunk, params.buckets))
        for i in range(len(chunk)):
            ids, counts = np.unique(np.concatenate([h[a[i] : b[i]] for h, a, b in parts]), return_counts=True)
            rows.append((ids, (counts / max(1, counts.sum())).astype(np.float32)))
    random = np.random.default_rng(params.seed)
    vectors = random.uniform(-1, 1, (params.buckets, params.dimensions)).astype(np.float32) / params.dimensions
    output, bias = np.zeros((classes, params.dimensions), np.float32), np.zeros(classes, np.float32)
    if len(set(labels)) < 2:
        return np.zeros((params.buckets, classes), np.float32), bias
    steps, done = params.epochs * len(rows), 0
    for _ in range(params.epochs):
        for i in random.permutation(len(rows)):
            rate, (ids, weights) = params.rate * (1 - done / steps), rows[i]
            done += 1
            hidden = weights @ vectors[ids]
            logits = output @ hidden + bias
            error = -np.exp(logits - logits.max())
            error /= -error.sum()
            error[labels[i]] += 1
            back = error @ output
            output += rate * np.outer(error, hidden)
            bias += rate * 0.1 * error
            vectors[ids] += rate * len(ids) ** 0.5 * np.outer(weights, back)
    return vectors @ output.T, bias


def probabilities(texts: list[str], model: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Class probabilities; those of a text without features come from the biases alone."""
    table, bias = model
    logits = np.zeros((len(texts), table.shape[1]))
    for at, chunk in ta.chunks(texts):
        total, part = np.zeros(len(chunk)), np.zeros((len(chunk), table.shape[1]))
        for hashes, a, b in features(chunk, len(table)):
            total += b - a
            for k in range(table.shape[1]):
                part[:, k] += ta.sums_by_text(np.ascontiguousarray(table[:, k])[hashes], a, b)
        logits[at : at + len(chunk)] = part / np.maximum(total, 1)[:, None]
    logits += bias
    exp = np.exp(logits - logits.max(axis=1, keepdims=True))
    return exp / exp.sum(axis=1, keepdims=True)


def score(docs: DataFrame, sample: DataFrame, params: QualityParams = QualityParams(), text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of ``docs`` and ``score``, the probability of class 1.

    Defined results: a null text counts as empty; an empty text is scored by the biases; a row that
    is repeated is scored each time it stands; an empty table gives no rows; an empty or one-class
    sample gives 0.5 throughout. Columns besides ``text`` and ``keep`` aren't read.
    """
    learned = sample.orderBy("_id", "text").toPandas() if "_id" in sample.columns else sample.toPandas()
    model = train(learned["text"].tolist(), learned["y"].astype(int).tolist(), params)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = keep or ["doc_id"]
    sent = kept if text in kept else [*kept, text]  # a text that is kept goes to Python once
    rows, at = docs.select(*sent), sent.index(text)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(kept)]) + ", score double"

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in ta.parts(batches):
            texts = [x or "" for x in batch.column(at).to_pylist()]
            values = probabilities(texts, shared.value)[:, 1] if texts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(values, pa.float64())], [*kept, "score"])

    return rows.mapInArrow(scored, schema)
