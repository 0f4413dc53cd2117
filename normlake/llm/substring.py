"""Operator 9, substring dedup: compressed FM-indexes, one for each shard of passages.

A window is ``width`` = 13 consecutive words. Its anchor is the least hash among its runs of ``GRAM`` = 4
words, so equal windows have equal anchors wherever they stand, and consecutive windows with one
anchor form a passage. Anchors that occur once in the corpus are settled. The passages of the
others are routed by anchor: a shard holds all passages of its anchors, each distinct text once with
the least and the greatest document that holds it, so all places of a window are in one shard.

A shard's passages form an FM-index over word numbers: a suffix array sorted as deep as a window, its
Burrows-Wheeler transform in a wavelet matrix of packed bits with rank counts, and backward search for the shard's
windows, all at once. A window whose interval shrinks to one place has been matched as
far as it matters; an interval that lasts all 13 words holds all its places, and
the least document among them decides for which documents the window is a repeat.

Which anchors repeat is known to the tasks through a bitmap of fixed size (``bitmap_bits``, 16 MB): a bit
that two anchors share lets passages through in vain, which costs time and changes nothing. An anchor of very
many documents would make a large group: its windows are routed one by one, by their own hash, and
equal windows are merged before the shuffle. There are ``most_hot`` such anchors at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textarrays as ta
from .staging import stage

GRAM = 4


@dataclass(frozen=True)
class RepeatParams:
    """``hot_least`` is the least number of occurrences of a hot anchor; an index holds about ``index_bytes`` of text."""

    width: int = 13
    bitmap_bits: int = 1 << 27
    hot_least: int = 2000
    most_hot: int = 100_000
    index_bytes: int = 2_000_000


class WaveletMatrix:
    """Rank over a sequence of small numbers, bit by bit from the highest; each level is packed bits with counts."""

    def __init__(self, values: np.ndarray, size: int) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray, int, int]] = []
        for shift in range(max(1, int(size - 1).bit_length()) - 1, -1, -1):
            bits = ((values >> shift) & 1).astype(np.uint8)
            words = np.zeros(len(bits) // 64 + 1, np.uint64)
            packed = np.packbits(bits, bitorder="little")
            words.view(np.uint8)[: len(packed)] = packed
            counts = np.zeros(len(words), np.int64)
            np.cumsum(np.bitwise_count(words[:-1]), out=counts[1:])
            zeros = len(bits) - int(bits.sum())
            self.levels.append((words, counts, zeros, shift))
            values = np.concatenate((values[bits == 0], values[bits == 1]))

    def place(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the first ``at`` values lead in the last level's order, for each symbol."""
        for words, counts, zeros, shift in self.levels:
            block = at >> 6
            ones = counts[block] + np.bitwise_count(words[block] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
            at = np.where((symbols >> shift) & 1, zeros + ones, at - ones)
        return at


class FMIndex:
    """Backward search over ``symbols`` (1 to ``size`` - 1; 0 parts the texts) for patterns of up to 16 symbols."""

    def __init__(self, symbols: np.ndarray, size: int) -> None:
        rank, span = symbols.astype(np.int64), 1
        while span < 16:  # sorted by 2, 4, 8, 16 symbols
            following = np.zeros(len(rank), np.int64)
            following[: len(rank) - span] = rank[span:]
            rank = np.unique(rank * (int(rank.max()) + 1) + following, return_inverse=True)[1]
            span *= 2
        self.suffixes = np.argsort(rank, kind="stable")
        transform = symbols[self.suffixes - 1].astype(np.int64)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(symbols, minlength=size))))
        self.matrix = WaveletMatrix(transform, size)
        names = np.arange(size)
        self.shift = self.first[:-1] - self.matrix.place(names, np.zeros(size, np.int64))

    def search(self, symbols: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals of ``symbols[s : s + width]``; one that has a single place isn't narrowed further."""
        last = symbols[starts + width - 1]
        low, high = self.first[last], self.first[last + 1]
        for step in range(width - 2, -1, -1):
            active = np.flatnonzero(high - low > 1)
            if not len(active):
                break
            own = symbols[starts[active] + step]
            low[active] = self.shift[own] + self.matrix.place(own, low[active])
            high[active] = self.shift[own] + self.matrix.place(own, high[active])
        return low, high


def least_documents(texts: list[bytes], firsts: list[int], width: int) -> list[np.ndarray]:
    """For each distinct text and each of its windows, the least document of the texts that hold the window."""
    numbers: dict[bytes, int] = {}
    parts, lengths = [], []
    for text in texts:
        words = text.split(b" ")
        parts.append([numbers.setdefault(w, len(numbers) + 1) for w in words] + [0])
        lengths.append(len(words))
    symbols = np.concatenate([np.array(p, np.int64) for p in parts])
    index = FMIndex(symbols, len(numbers) + 1)
    count = np.array(lengths) - width + 1
    base = np.cumsum(np.array(lengths) + 1) - np.array(lengths) - 1
    owner = np.repeat(np.arange(len(texts)), count)
    starts = np.repeat(base, count) + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    low, high = index.search(symbols, starts, width)
    least = np.array(firsts, np.int64)
    out = least[owner]
    several = np.flatnonzero(high - low > 1)
    if len(several):
        begin, inverse = np.unique(low[several], return_inverse=True)
        end = np.zeros(len(begin), np.int64)
        end[inverse] = high[several]  # equal windows have one interval, others' don't overlap
        text_of = np.repeat(np.arange(len(texts)), np.array(lengths) + 1)
        by_place = np.append(least[text_of[index.suffixes]], np.iinfo(np.int64).max)
        out[several] = np.minimum.reduceat(by_place, np.column_stack((begin, end)).ravel())[::2][inverse]
    return np.split(out, np.cumsum(count)[:-1])


def _passages(texts: list[bytes], width: int):
    """The chunk's normalised bytes, its words' bounds, and its passages: text, anchor, first window, number of windows."""
    values, starts, ends = ta.byte_values(texts)
    first, last = ta.word_bounds(values)
    hashes = ta.word_hashes(values, first, last)
    begin, stop = np.searchsorted(first, starts), np.searchsorted(first, ends)
    none = np.zeros(0, np.int64)
    if len(hashes) < width:
        return values, first, last, begin, none, np.zeros(0, np.uint64), none, none
    grams = hashes[: len(hashes) - GRAM + 1].copy()
    for k in range(1, GRAM):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + hashes[k : len(hashes) - GRAM + 1 + k]
    least, span, want = ta.mix(grams), 1, width - GRAM + 1
    while 2 * span <= want:
        least, span = np.minimum(least[:-span], least[span:]), 2 * span
    if want > span:
        least = np.minimum(least[: len(least) - (want - span)], least[want - span :])
    owner = np.repeat(np.arange(len(texts)), stop - begin)[: len(least)]
    valid = np.arange(len(least)) + width <= stop[owner]
    change = np.ones(len(least), bool)
    change[1:] = (least[1:] != least[:-1]) | (owner[1:] != owner[:-1]) | ~valid[:-1]
    heads = np.flatnonzero(change & valid)
    bounds = np.flatnonzero(change | ~valid)
    following = np.append(bounds, len(least))[np.searchsorted(bounds, heads, side="right")]
    return values, first, last, begin, owner[heads], least[heads], heads, following - heads


def _whole(batch_texts: list[bytes | None]) -> list[bytes]:
    return [b" ".join((x or b"").split()) for x in batch_texts]


def _anchors(docs: DataFrame, width: int) -> DataFrame:
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in ta.parts(batches):
            for _, texts in ta.chunks(_whole(batch.column(0).to_pylist())):
                *_, owner, anchor, _, _ = _passages(texts, width)
                once = np.unique(anchor ^ ta.mix(owner.astype(np.uint64)), return_index=True)[1]
                yield pa.RecordBatch.from_arrays([pa.array(anchor[once].view(np.int64))], ["anchor"])

    return docs.where("doc_id is not null").select("_text").mapInArrow(found, "anchor long")


def _selected(batch: pa.RecordBatch, width: int, bitmap: np.ndarray, hot: np.ndarray):
    """``(document's index in the batch, route, first word, text)`` of each passage whose anchor may repeat."""
    mask = np.uint64(len(bitmap) * 64 - 1)
    for at, texts in ta.chunks(_whole(batch.column(1).to_pylist())):
        values, first, last, begin, owner, anchor, heads, windows = _passages(texts, width)
        slot = anchor & mask
        keep = np.flatnonzero((bitmap[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1))
        is_hot = hot[np.minimum(np.searchsorted(hot, anchor[keep]), len(hot) - 1)] == anchor[keep] if len(hot) else np.zeros(len(keep), bool)
        data = values.tobytes()
        own, head = owner[keep], heads[keep]
        a, b = first[head].tolist(), last[head + windows[keep] + width - 2].tolist()
        for i, doc, route, start, warm in zip(range(len(keep)), (own + at).tolist(), anchor[keep].view(np.int64).tolist(), (head - begin[own]).tolist(), is_hot.tolist()):
            if not warm:
                yield doc, route, start, data[a[i] : b[i]]
                continue
            for k in range(int(windows[keep[i]])):  # a hot anchor's windows go their own ways
                text = data[first[head[i] + k] : last[head[i] + k + width - 1]]
                yield doc, xxhash.xxh64_intdigest(text, 11) - (1 << 63), start + k, text


def _signed(text: bytes) -> int:
    return xxhash.xxh64_intdigest(text, 5) - (1 << 63)


def _decide(batches: Iterator[pa.RecordBatch], params: RepeatParams) -> Iterator[pa.RecordBatch]:
    """Least documents of the windows of each shard, from rows sorted by route; shards end between routes."""
    texts: dict[bytes, list[int]] = {}
    held, before = 0, None

    def indexed() -> pa.RecordBatch:
        least = least_documents(list(texts), [d[0] for d in texts.values()], params.width)
        rows = [(d[2], _signed(t), x) for (t, d), x in zip(texts.items(), least) if x.min() < d[1]]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.int64()))], ["route", "code", "least"])

    for batch in batches:
        for route, text, low, high in zip(*(c.to_pylist() for c in batch.columns)):
            if route != before and held >= params.index_bytes:
                yield indexed()
                texts, held = {}, 0
            before = route
            if (known := texts.get(text)) is None:
                texts[text] = [low, high, route]
                held += len(text)
            else:
                known[0], known[1] = min(known[0], low), max(known[1], high)
    if texts:
        yield indexed()


def repeats(docs: DataFrame, params: RepeatParams = RepeatParams()) -> DataFrame:
    """``doc_id, _th, starts``: the first words of each document's windows that also start in a smaller one."""
    spark = docs.sparkSession
    shared = stage(_anchors(docs, params.width).groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"))
    slot = F.col("anchor").bitwiseAND(params.bitmap_bits - 1)
    bits = shared.groupBy(F.shiftright(slot, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(anchor & 63L as int))")).alias("b")).toArrow()
    bitmap = np.zeros(params.bitmap_bits // 64, np.uint64)
    bitmap[bits.column("w").to_numpy()] = bits.column("b").to_numpy().view(np.uint64)
    total = shared.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("s")).first()["s"]
    hot_rows = shared.where(F.col("n") > max(params.hot_least, total // params.most_hot)).select("anchor").toArrow()
    hot = np.sort(hot_rows.column("anchor").to_numpy().astype(np.int64).view(np.uint64))
    known = spark.sparkContext.broadcast((bitmap, hot))
    width = params.width

    def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            merged: dict[bytes, list[int]] = {}
            for part in ta.parts(iter([batch])):
                ids = part.column(0).to_pylist()
                for doc, route, _, text in _selected(part, width, *known.value):
                    if (entry := merged.get(text)) is None:
                        merged[text] = [route, ids[doc], ids[doc]]
                    else:
                        entry[1], entry[2] = min(entry[1], ids[doc]), max(entry[2], ids[doc])
            columns = [pa.array([e[0] for e in merged.values()], pa.int64()), pa.array(list(merged), pa.binary()), *(pa.array([e[k] for e in merged.values()], pa.int64()) for k in (1, 2))]
            yield pa.RecordBatch.from_arrays(columns, ["route", "text", "low", "high"])

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in ta.parts(batches):
            found = list(zip(*[(doc, route, _signed(text), start) for doc, route, start, text in _selected(batch, width, *known.value)])) or [[], [], [], []]
            at = pa.array(found[0], pa.int64())
            columns = [pa.array(found[1], pa.int64()), pa.array(found[2], pa.int64()), batch.column(0).take(at), batch.column(2).take(at), pa.array(found[3], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["route", "code", "doc_id", "_th", "start"])

    rows = docs.where("doc_id is not null").select("doc_id", "_text", "_th")
    sharded = rows.mapInArrow(passages, "route long, text binary, low long, high long").repartition("route").sortWithinPartitions("route")
    decided = stage(sharded.mapInArrow(lambda batches: _decide(batches, params), "route long, code long, least array<long>"))
    at = rows.mapInArrow(places, "route long, code long, doc_id long, _th long, start int").join(decided, ["route", "code"])
    hits = F.filter(F.transform("least", lambda x, j: F.when(x < F.col("doc_id"), F.col("start") + j)), lambda x: x.isNotNull())
    return at.select("doc_id", "_th", hits.alias("hits")).where(F.size("hits") > 0).groupBy("doc_id", "_th").agg(F.flatten(F.collect_list("hits")).alias("starts"))


def remove_repeats(docs: DataFrame, params: RepeatParams = RepeatParams(), text: str = "text", doc_id: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of every row, ``n_words``, ``n_removed`` and ``kept`` (the words that stay, one space between two).

    Defined results: a null or empty text has no words and keeps the empty text; of rows with equal ids none is
    smaller than the other; a row without an id neither loses words nor costs others theirs; an empty
    table gives no rows. ``keep`` names columns of ``docs`` (default: the id alone).
    """
    kept = keep or [doc_id]
    base = docs.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(kept)], F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("_text"), F.xxhash64(text).alias("_th"))
    sent = [f"_k{i}" for i in range(len(kept))] + ["_text"] * (text not in kept)  # a text that is kept is shuffled and goes to Python once
    joined = base.join(repeats(base, params), ["doc_id", "_th"], "left").select(*sent, "starts")
    width, n, at = params.width, len(kept), kept.index(text) if text in kept else len(kept)
    fields = [f"`_k{i}` {joined.schema[i].dataType.simpleString()}" for i in range(n)]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in ta.parts(batches):
            counts, removed, texts = [], [], []
            for value, starts in zip(batch.column(at).cast(pa.binary()).to_pylist(), batch.column(len(sent)).to_pylist()):
                words = (value or b"").split()
                counts.append(len(words))
                if starts:
                    cover = np.zeros(len(words) + 1, np.int64)
                    first = np.unique(np.array(starts))
                    cover[first] += 1
                    np.add.at(cover, first + width, -1)
                    stays = np.cumsum(cover)[:-1] == 0
                    removed.append(len(words) - int(stays.sum()))
                    words = [words[i] for i in np.flatnonzero(stays).tolist()]
                else:
                    removed.append(0)
                texts.append(b" ".join(words).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.string())], [*batch.schema.names[:n], "n_words", "n_removed", "kept"])

    out = joined.mapInArrow(cut, ", ".join([*fields, "n_words long, n_removed long, kept string"]))
    return out.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(kept)], "n_words", "n_removed", "kept")
