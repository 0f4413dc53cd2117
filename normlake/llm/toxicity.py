"""Operator 4, toxicity: compression distance to two zstandard dictionaries.

Texts are lower-cased and cut into windows of ``words`` words. Each window is compressed twice, with a dictionary
trained on ordinary text and with the same one preceded by a dictionary trained on toxic text. Ordinary
passages lie at the same distance from both; the bytes that the toxic dictionary saves are its evidence.

zstandard trains the toxic dictionary in rounds. At first it sees all windows of the toxic texts, most of which are
ordinary; in each later round it sees the windows whose saving was ``least_saving`` bytes or more, and
its dictionary is smaller (``toxic_bytes``), so that what only toxic texts repeat is what stays. A window that stands in
several texts trains once: copies of a text make nothing in it toxic. Ordinary windows that save as much are added to
the ordinary dictionary by training another on them. No word is chosen by other means. Labelled rows that trained neither dictionary calibrate: each number of saved bytes weighs as much as
the logarithm of its share among toxic and ordinary texts' windows, and a logistic function of a
text's total weight, held to the training rows' prior, is its score.

Training sees at most ``rows_per_class`` labelled rows of each class, one for each id, on the driver; the broadcast model
has ``ordinary_bytes`` and less than the sum of ``toxic_bytes`` for each round, whatever the size of the corpus.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality import held_out

#: Words of a text that are cut out at once, a multiple of all usual window lengths.
BLOCK = 60_060
#: Savings below and above these count as these.
LEVELS = (-3, 10)
#: The repeat offsets that every trained dictionary has between its entropy tables and its content.
REPEATS = bytes.fromhex("010000000400000008000000")


@dataclass(frozen=True)
class ToxicityParams:
    """``rows_per_class`` and ``max_chars`` bound the training sample; ``trained`` is the share of it that trains the dictionaries."""

    words: int = 6
    ordinary_bytes: int = 200_000
    toxic_bytes: tuple[int, ...] = (40_000, 16_384, 8192, 4096, 2048, 2048)
    least_saving: int = 3
    trained: float = 0.6
    rows_per_class: int = 1500
    max_chars: int = 30_000


@dataclass(frozen=True)
class ToxicityModel:
    """Entropy tables (shared), the contents of both dictionaries, each saving's weight, the logistic weights."""

    tables: bytes
    ordinary: bytes
    toxic: bytes
    levels: tuple[float, ...]
    logistic: tuple[float, ...]
    words: int


def windows(text: str, words: int) -> Iterator[bytes]:
    """Runs of ``words`` words (the last may be shorter), with a space at either end."""
    rest, block = text.encode("utf-8", "replace").lower(), BLOCK // words * words
    while rest:
        found = rest.split(None, block)
        rest = found.pop() if len(found) > block else b""
        for i in range(0, len(found), words):
            yield b" " + b" ".join(found[i : i + words]) + b" "


def _trained(samples: list[bytes], size: int, segment: int) -> tuple[bytes, bytes]:
    """Entropy tables and content of a trained dictionary; samples too few to train on are the content, without tables."""
    try:
        whole = zstandard.train_dictionary(size, samples, k=segment, d=6).as_bytes()
    except zstandard.ZstdError:
        return b"", b"".join(dict.fromkeys(samples))[-size:]
    at = whole.index(REPEATS) + len(REPEATS)
    return whole[:at], whole[at:]


def _compressor(tables: bytes, content: bytes) -> Callable[[bytes], bytes]:
    params = zstandard.ZstdCompressionParameters(
        window_log=20, hash_log=18, chain_log=18, search_log=4, min_match=5, target_length=32, strategy=zstandard.STRATEGY_BTLAZY2, write_content_size=False, write_checksum=False, write_dict_id=False
    )
    kind = zstandard.DICT_TYPE_FULLDICT if tables else zstandard.DICT_TYPE_RAWCONTENT
    data = zstandard.ZstdCompressionDict(tables + content, dict_type=kind) if content else None
    return zstandard.ZstdCompressor(compression_params=params, dict_data=data).compress


def _pair(model: ToxicityModel) -> tuple[Callable, Callable]:
    return _compressor(model.tables, model.ordinary), _compressor(model.tables, model.toxic + model.ordinary)


def savings(text: str, words: int, pair: tuple[Callable, Callable]) -> np.ndarray:
    """What the second compressor saves on each window, in bytes."""
    plain, toxic = pair
    return np.array([len(plain(w)) - len(toxic(w)) for w in windows(text, words)], np.int64)


def _counts(found: np.ndarray) -> np.ndarray:
    """The numbers of windows at each level of saving."""
    return np.bincount(np.clip(found, *LEVELS) - LEVELS[0], minlength=LEVELS[1] - LEVELS[0] + 1)


def _features(counts: np.ndarray, levels: np.ndarray) -> list[float]:
    """The windows' total weight, the same by the root of their number, the number's logarithm, and a constant."""
    total, n = float(counts @ levels), int(counts.sum())
    return [total, total / max(n, 1) ** 0.5, float(np.log1p(n)), 1.0]


def _calibrated(rows: np.ndarray, labels: np.ndarray, prior: float, ridge: float = 1e-3) -> tuple[float, ...]:
    """Logistic weights by Newton's method, the two classes weighted to ``prior``."""
    share = labels.mean()
    weight = np.where(labels == 1, prior / share, (1 - prior) / (1 - share))
    penalty = ridge * len(rows) * np.diag([1.0] * (rows.shape[1] - 1) + [0.0])
    out = np.zeros(rows.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(rows @ out, -50, 50)))
        slope = rows.T @ (weight * (labels - p)) - penalty @ out
        curve = (rows * (weight * p * (1 - p))[:, None]).T @ rows + penalty + 1e-9 * np.eye(len(out))
        out = out + np.clip(np.linalg.solve(curve, slope), -4, 4)
    return tuple(out.tolist())


def _dictionaries(ordinary: list[str], toxic: list[str], params: ToxicityParams) -> tuple[bytes, bytes, bytes]:
    """The shared entropy tables and both dictionaries' contents.

    In the first round, when both kinds of windows are mostly ordinary text, a third dictionary of further ordinary
    texts stands where the toxic one does, so that neither side is the longer.
    """
    cut = [list(dict.fromkeys(w for x in texts for w in windows(x, params.words))) for texts in (ordinary[::3] + ordinary[1::3], ordinary[2::3], toxic)]
    tables, base = _trained(cut[0], params.ordinary_bytes, 64)
    even, found = _trained(cut[1], params.toxic_bytes[0], 64)[1], _trained(cut[2], params.toxic_bytes[0], 64)[1]
    plain = _compressor(tables, even + base)
    for size in params.toxic_bytes[1:]:
        second = _compressor(tables, found + base)
        seen, alike = ([w for w in part if len(plain(w)) - len(second(w)) >= params.least_saving] for part in (cut[2], cut[0] + cut[1]))
        if not seen:
            return tables, base, b""
        found, base = _trained(seen, size, 16)[1], _trained(alike, params.toxic_bytes[0], 16)[1] + base
        plain = _compressor(tables, base)
    return tables, base, found


def train(texts: list[str], labels: list[int], prior: float, params: ToxicityParams = ToxicityParams()) -> ToxicityModel:
    """Both dictionaries and the calibrated weights.

    ``prior`` is the share of toxic rows among all training rows. A sample with fewer than two texts of a
    class gives ``prior`` for every text.
    """
    by = {y: list(dict.fromkeys(x for x, z in zip(texts, labels) if z == y)) for y in (0, 1)}
    held = min(max(prior, 1e-6), 1 - 1e-6)
    flat = (0.0, 0.0, 0.0, float(np.log(held / (1 - held))))
    none = (0.0,) * (LEVELS[1] - LEVELS[0] + 1)
    if min(len(by[0]), len(by[1])) < 2:
        return ToxicityModel(b"", b"", b"", none, flat, params.words)
    cut = {y: min(max(1, round(len(x) * params.trained)), len(x) - 1) for y, x in by.items()}
    tables, ordinary, toxic = _dictionaries(by[0][: cut[0]], by[1][: cut[1]], params)
    draft = ToxicityModel(tables, ordinary, toxic, none, flat, params.words)
    pair = _pair(draft)
    unseen = {y: np.array([_counts(savings(x, params.words, pair)) for x in by[y][cut[y] :]]) for y in by}
    shares = {y: (c.sum(axis=0) + 1.0) / (c.sum() + len(none)) for y, c in unseen.items()}
    levels = np.log(shares[1] / shares[0])
    rows = np.array([_features(c, levels) for y in (0, 1) for c in unseen[y]])
    marks = np.repeat([0.0, 1.0], [len(unseen[0]), len(unseen[1])])
    return ToxicityModel(tables, ordinary, toxic, tuple(levels.tolist()), _calibrated(rows, marks, held), params.words)


def rate(texts: list[str | None], model: ToxicityModel) -> list[float]:
    """Scores of whole texts."""
    pair, levels, weights = _pair(model), np.array(model.levels), np.array(model.logistic)
    logits = [np.dot(_features(_counts(savings(text or "", model.words, pair)), levels), weights) for text in texts]
    return [float(1 / (1 + np.exp(-np.clip(x, -50, 50)))) for x in logits]


def score(docs: DataFrame, sample: DataFrame, prior: float, params: ToxicityParams = ToxicityParams(), text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of ``docs`` and ``score``, the calibrated probability of a toxic text.

    Defined results: null and empty texts have no window and get the score of none; repeated rows
    are scored each time; an empty table gives no rows; a one-class sample gives ``prior``. Columns
    besides ``text`` and ``keep`` aren't read.
    """
    learned = sample.select("_id", "text", "y").orderBy(F.xxhash64("_id"), "_id", "text").toPandas()
    model = train(learned["text"].tolist(), learned["y"].astype(int).tolist(), prior, params)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = keep or ["doc_id"]
    rows = docs.select(*kept, F.col(text).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]) + ", score double"

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = rate(batch.column(len(kept)).to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(values, pa.float64())], [*kept, "score"])

    return rows.mapInArrow(scored, schema)


def prior(labels: DataFrame, label: str, folds: int, fold: int, doc_id: str = "doc_id") -> float:
    """The share of label 1 among the training rows that are labelled 0 or 1 (0 if there are none)."""
    known = labels.where(F.col(label).isin(0, 1) & ~held_out(F.col(doc_id), folds, fold))
    return known.agg(F.coalesce(F.avg(F.col(label).cast("double")), F.lit(0.0)).alias("p")).first()["p"]
