"""Document fingerprints: improbable byte windows in chained Bloom filters, compared by normalised bit overlap.

Every window of 16 bytes has an entropy, in thousandths of the greatest possible. A histogram over all windows of all documents says how
rare each value is. In a text each run of 64 neighbouring windows votes for its rarest one (the first of equals); windows with 16 votes, or
as many as the text's foremost, are its features. A text of at most 160 windows, which fit into one filter, has them all. Features go by their order in the text into Bloom filters of 2,048 bits, five bits each, 160 to a filter; a filter that
is full starts the next. Two filters' overlap is the share of common bits beyond what chance gives; two chains' likeness is the mean, weighted by bits, of each filter's best match.

A null text is empty. An empty text has no filter: it is like another empty one (1), and nothing else (0). A text of under 16 bytes is one
feature. Equal texts have equal fingerprints, wherever they stand. Texts are taken whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textarrays import CHUNK, mix

WINDOW, RUN, VOTES = 16, 64, 16
LEVELS = 1000
BITS, HASHES, PER_FILTER = 2048, 5, 160
#: Windows that are judged at a time, whatever the length of a text.
SEGMENT = 1 << 17
#: Slices of ids that documents are dealt to, and the bytes of text that one should have.
MOST_SLICES, SLICE_BYTES = 16_384, 16 << 20
_COUNTS = np.arange(WINDOW + 1)
_TERM = np.rint(_COUNTS * np.log2(np.maximum(_COUNTS, 1)) * 65536).astype(np.int64)
_STEP = np.concatenate([[0], np.diff(_TERM)]).astype(np.int64)
_FULL = int(_TERM[WINDOW])
_POWERS = mix(np.arange(1, WINDOW + 1, dtype=np.uint64)) | np.uint64(1)


def entropies(values: np.ndarray) -> np.ndarray:
    """The entropy level (0 to 1000) of the window that starts at each byte and fits."""
    n = len(values) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    # How often a byte comes again in the window that it starts, and before in the one that it ends.
    after, before = np.zeros(len(values), np.uint8), np.zeros(len(values), np.uint8)
    for d in range(1, WINDOW):
        same = (values[:-d] == values[d:]).view(np.uint8)
        after[:-d] += same
        before[d:] += same
    total = np.empty(n, np.int64)
    total[0] = _TERM[np.bincount(values[:WINDOW], minlength=256)].sum()
    total[1:] = _STEP[before[WINDOW:].astype(np.int64) + 1] - _STEP[after[: n - 1].astype(np.int64) + 1]
    return LEVELS * (_FULL - np.cumsum(total)) // _FULL


def histogram(texts: list[bytes]) -> np.ndarray:
    """How many windows of the texts have each entropy level."""
    values, starts, ends = _joined(texts)
    found = np.zeros(LEVELS + 1, np.int64)
    for first in range(0, len(values), SEGMENT):
        levels = entropies(values[first : first + SEGMENT + WINDOW - 1])
        found += np.bincount(levels[_whole(starts, ends, first, len(levels))], minlength=LEVELS + 1)
    return found


def ranks(counts: np.ndarray) -> np.ndarray:
    """Each level's place by rarity, the rarest first; of equally rare ones the lower level."""
    out = np.empty(LEVELS + 1, np.int64)
    out[np.lexsort((np.arange(LEVELS + 1), counts))] = np.arange(LEVELS + 1)
    return out


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lengths)
    return np.frombuffer(b"".join(texts), np.uint8), ends - lengths, ends


def _whole(starts: np.ndarray, ends: np.ndarray, first: int, n: int) -> np.ndarray:
    """Which of ``n`` windows from ``first`` lie in one text."""
    at = np.arange(first, first + n)
    return at + WINDOW <= ends[np.searchsorted(ends, at, side="right")]


def _votes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """How many runs of each byte's text chose the window that starts there."""
    votes = np.zeros(len(values) + RUN, np.uint8)
    windows = np.maximum(ends - starts - WINDOW + 1, 0)
    runs = np.where(windows > 0, np.maximum(windows - RUN + 1, 1), 0)
    low = np.int64(1) << 32
    for first in range(0, len(values), SEGMENT):
        levels = entropies(values[first : first + SEGMENT + RUN + WINDOW - 2])
        key = np.full(min(SEGMENT, len(values) - first) + RUN - 1, np.iinfo(np.int64).max)
        fits = np.flatnonzero(_whole(starts, ends, first, len(levels)))
        key[fits] = rank[levels[fits]] * low + fits
        width = 1
        while width < RUN:
            key = np.minimum(key[:-width], key[width:])
            width *= 2
        at = np.arange(first, first + len(key))
        text = np.searchsorted(ends, at, side="right")
        valid = at < starts[text] + runs[text]
        chosen = np.bincount(key[valid] % low, minlength=1)
        votes[first : first + len(chosen)] += chosen.astype(np.uint8)
    return votes


def fingerprints(texts: list[bytes], rank: np.ndarray) -> list[np.ndarray]:
    """Each text's filters, ``(filters, 256)`` bytes."""
    values, starts, ends = _joined(texts)
    owners, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    if len(values):
        votes = _votes(values, starts, ends, rank)
        if (ends - starts >= WINDOW).any():
            dense = ends - starts - WINDOW < PER_FILTER
            owner = np.repeat(np.arange(len(texts)), ends - starts)
            fits = np.arange(len(values)) + WINDOW <= ends[owner]
            # Windows that don't fit have no votes, so what follows a long text up to the next one adds nothing.
            most = np.zeros(len(texts), np.uint8)
            long = np.flatnonzero(ends - starts >= WINDOW)
            most[long] = np.maximum.reduceat(votes, starts[long])
            at = np.flatnonzero((dense[owner] & fits) | ((votes[: len(values)] > 0) & (votes[: len(values)] >= np.minimum(most, VOTES)[owner])))
            windows = sliding_window_view(values, WINDOW)
            owners.append(owner[at])
            hashes += [((windows[at[i : i + 8192]].astype(np.uint64) + np.uint64(1)) * _POWERS).sum(axis=1, dtype=np.uint64) for i in range(0, len(at), 8192)]
    short = [i for i, t in enumerate(texts) if 0 < len(t) < WINDOW]
    owners.append(np.array(short, np.int64))
    hashes.append(np.array([xxhash.xxh3_64_intdigest(texts[i]) for i in short], np.uint64))
    owner, code = np.concatenate(owners), mix(np.concatenate(hashes))
    pairs = np.empty(len(owner), [("o", np.int64), ("h", np.uint64)])
    pairs["o"], pairs["h"] = owner, code
    once = np.sort(np.unique(pairs, return_index=True)[1])  # a feature that comes again adds nothing
    once = once[np.argsort(owner[once], kind="stable")]
    owner, code = owner[once], code[once]
    sizes = np.bincount(owner, minlength=len(texts))
    place = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    filters = -(-sizes // PER_FILTER)
    offsets = np.cumsum(filters) - filters
    bits = np.zeros((int(filters.sum()), BITS), bool)
    for k in range(HASHES):
        bits[offsets[owner] + place // PER_FILTER, (code >> np.uint64(11 * k)).astype(np.int64) % BITS] = True
    packed = np.packbits(bits, axis=1)
    return [packed[o : o + n] for o, n in zip(offsets.tolist(), filters.tolist())]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: how well the filters of two fingerprints match."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if len(a) == len(b) and (a == b).all():
        return 1.0
    sides = []
    if len(a) <= len(b):
        sides.append(_matched(a, b))
    if len(b) <= len(a):
        sides.append(_matched(b, a))
    return sum(sides) / len(sides)


def _matched(few: np.ndarray, many: np.ndarray) -> float:
    """The mean of each filter's best normalised overlap with ``many``'s filters, in blocks of them."""
    own = np.unpackbits(few, axis=1).astype(np.float32)
    n, best = own.sum(axis=1).astype(np.float64), np.zeros(len(few))
    for i in range(0, len(many), 512):
        other = np.unpackbits(many[i : i + 512], axis=1).astype(np.float32)
        m = other.sum(axis=1).astype(np.float64)
        chance = np.outer(n, m) / BITS
        shared = (own @ other.T).astype(np.float64)
        best = np.maximum(best, ((shared - chance) / (np.minimum.outer(n, m) - chance)).max(axis=1))
    return float((np.clip(best, 0, 1) * n).sum() / n.sum())


def rarity(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Every level's place by rarity over all windows of all documents, and the bytes of their texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, size = np.zeros(LEVELS + 1, np.int64), 0
        for batch in batches:
            for texts in _chunks(t.encode("utf-8", "surrogatepass") for t in batch.column(0).to_pylist() if t):
                total += histogram(texts)
                size += sum(map(len, texts))
        level = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([*level.tolist(), -1]), pa.array([*total[level].tolist(), size])], names=["level", "n"])

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "level long, n long").groupBy("level").agg(F.sum("n").alias("n")).collect()  # 1,002 at most
    counts = np.zeros(LEVELS + 2, np.int64)
    for r in rows:
        counts[r["level"]] = r["n"]
    return ranks(counts[:-1]), int(counts[-1])


def _chunks(texts: Iterator[bytes]) -> Iterator[list[bytes]]:
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= CHUNK:
            yield held
            held, size = [], 0
    if held:
        yield held


def _hex(filters: np.ndarray) -> str:
    return filters.tobytes().hex()


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by the first as many (or all) of the next document."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def neighbours(docs: DataFrame, size: int) -> DataFrame:
    """``slice, last, doc_id, text``: documents dealt by descending id, each slice ended by a copy of the next one's first (``last``).

    So a slice's rows, sorted by ``last`` and descending id, hold every document's next one just behind it; the last slice is
    followed by the first. Ids are taken to be nearly unique: rows of one id lie in one slice.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    parts = int(min(MOST_SLICES, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SLICE_BYTES))))
    cuts = rows.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5], 20 * parts)).first()[0] or []
    bounds = np.unique(np.array(cuts, np.int64))

    @F.pandas_udf("int")
    def slice_of(ids: pd.Series) -> pd.Series:
        known = ids.notna().to_numpy()
        out = np.full(len(ids), len(bounds), np.int32)
        out[known] = len(bounds) - np.searchsorted(bounds, ids[known].to_numpy(np.int64), side="right")
        return pd.Series(out)

    dealt = rows.withColumn("slice", slice_of("doc_id"))
    tops = dealt.groupBy("slice").agg(F.max("doc_id").alias("doc_id"))  # one row for each slice
    filled = sorted(r["slice"] for r in tops.select("slice").collect())
    before = spark.createDataFrame([(s, filled[i - 1]) for i, s in enumerate(filled)], "slice int, before int")
    at = F.broadcast(tops.select(F.col("slice").alias("_s"), F.col("doc_id").alias("_d")))
    heads = dealt.join(at, (F.col("slice") == F.col("_s")) & F.col("doc_id").eqNullSafe(F.col("_d")), "left_semi").groupBy("slice", "doc_id").agg(F.min("text").alias("text"))
    ends = heads.join(F.broadcast(before), "slice").select(F.col("before").alias("slice"), F.lit(True).alias("last"), "doc_id", "text")
    both = dealt.select("slice", F.lit(False).alias("last"), "doc_id", "text").unionByName(ends)
    return both.repartitionById(len(bounds) + 1, F.col("slice")).sortWithinPartitions("slice", "last", F.desc("doc_id"), "text")


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_filters long"


def compare(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint beside that of its edited text and its likeness to this one and to the next document.

    ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_filters``. Documents follow each other by descending id
    (null: last; of equal ids the lesser text first), the first follows the last; a lone document follows itself. An empty table gives no rows.
    """
    rank, size = rarity(docs)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_filters"]
        types = [pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64(), pa.int64()]

        def rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist())

        held: list[tuple] = []  # rows, the first of which was the last of the chunk before
        first: np.ndarray | None = None
        chars = 0

        def done() -> pa.RecordBatch:
            nonlocal first
            own = [first] if first is not None else []
            own += fingerprints([t.encode("utf-8", "surrogatepass") for _, _, t in held[len(own) :]], rank)
            asked = [i for i in range(len(held) - 1) if not held[i][0]]
            changed = [edited(held[i][2], held[i + 1][2]).encode("utf-8", "surrogatepass") for i in asked]
            out = []
            for i, text, print_ in zip(asked, changed, fingerprints(changed, rank)):
                out.append((held[i][1], len(held[i][2]), hashlib.sha256(text).hexdigest(), _hex(own[i]), _hex(print_), likeness(own[i], print_), likeness(own[i], own[i + 1]), len(own[i])))
            first = own[-1]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=names)

        for row in rows():
            held.append(row)
            chars += len(row[2])
            if chars >= CHUNK:
                yield done()
                held, chars = held[-1:], 0
        if len(held) > 1:
            yield done()

    return neighbours(docs, size).mapInArrow(judge, SCHEMA)
