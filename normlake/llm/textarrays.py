"""Text batches as numpy arrays: code points, words and their hashes.

These are the small vectorised helpers which the Arrow-batched operators share. Texts of one
chunk lie in one array, each followed by ``PAD`` line feeds, so that no window that starts in a
text reads another one: what comes out for a text doesn't depend on its neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

PAD = 5
CHUNK = 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x100000001B3
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def chunks(texts: list, size: int = CHUNK) -> Iterator[tuple[int, list]]:
    """``(first index, texts)`` runs of about ``size`` characters; a longer text stands alone."""
    first, total = 0, 0
    for i, text in enumerate(texts):
        n = len(text)
        if i > first and total + n > size:
            yield first, texts[first:i]
            first, total = i, 0
        total += n
    if first < len(texts):
        yield first, texts[first:]


def parts(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Arrow batches in parts of so many rows, so that what is made of a part's texts goes before the next one's is made."""
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The chunk's code points and each text's first index and end in them."""
    gap = "\n" * PAD
    points = np.frombuffer((gap.join(texts) + gap).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.zeros(len(texts), np.int64)
    np.cumsum(lengths[:-1] + PAD, out=starts[1:])
    return points, starts, starts + lengths


def byte_values(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As :func:`code_points`, over UTF-8 bytes."""
    gap = b"\n" * PAD
    values = np.frombuffer(gap.join(texts) + gap, np.uint8)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.zeros(len(texts), np.int64)
    np.cumsum(lengths[:-1] + PAD, out=starts[1:])
    return values, starts, starts + lengths


def mix(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits."""
    values = values ^ (values >> np.uint64(32))
    values = values * _MIX
    return values ^ (values >> np.uint64(29))


def ngram_hashes(points: np.ndarray, n: int) -> np.ndarray:
    """A 32-bit hash of the ``n`` values from each position on; the last ``n - 1`` positions have none."""
    out = points[: len(points) - n + 1].astype(np.uint32)
    for k in range(1, n):
        out *= np.uint32(0x01000193)
        out ^= points[k : len(points) - n + 1 + k]
    out *= np.uint32(0x9E3779B1)
    out ^= out >> np.uint32(15)
    out *= np.uint32(0x85EBCA77)
    out ^= out >> np.uint32(13)
    return out


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, 2 * len(_powers))
        base, inverse = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        base[0] = inverse[0] = 1
        _powers, _inverses = np.cumprod(base), np.cumprod(inverse)
    return _powers, _inverses


def word_bounds(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words, the maximal runs without space or U+0009 to U+000D."""
    inside = np.ones(len(values) + 1, bool)
    np.not_equal(values, 32, out=inside[1:])
    inside[1:] &= (values < 9) | (values > 13)
    inside[0] = False
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[0::2], edges[1::2]


def word_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word; equal words have equal hashes wherever they stand.

    Words are hashed in runs of up to ``CHUNK`` values, so the power tables stay that long whatever the text; a longer word has a hash of its own kind.
    """
    out, i = np.empty(len(starts), np.uint64), 0
    while i < len(starts):
        j = int(np.searchsorted(ends, starts[i] + CHUNK, side="right"))
        first = int(starts[i])
        if j <= i:
            out[i] = xxhash.xxh64_intdigest(values[first : int(ends[i])].tobytes(), 3)
            i += 1
            continue
        own = values[first : int(ends[j - 1])]
        powers, inverses = _power_tables(min(CHUNK, len(own)) + 1)
        sums = np.zeros(len(own) + 1, np.uint64)
        np.cumsum((own.astype(np.uint64) + np.uint64(1)) * powers[: len(own)], out=sums[1:])
        out[i:j] = mix((sums[ends[i:j] - first] - sums[starts[i:j] - first]) * inverses[starts[i:j] - first])
        i = j
    return out


def sums_by_text(values: np.ndarray, firsts: np.ndarray, lasts: np.ndarray) -> np.ndarray:
    """Sums of ``values[first:last]`` for each text, zero where there is nothing."""
    totals = np.zeros(len(values) + 1, np.float64)
    np.cumsum(values, out=totals[1:], dtype=np.float64)
    # Word pairs are one fewer than words: an empty text after the last word begins past them.
    return totals[np.minimum(lasts, len(values))] - totals[np.minimum(firsts, len(values))]
