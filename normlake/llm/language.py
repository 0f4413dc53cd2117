"""Operator 8, language ID: bit-sliced Bloom filters over n-grams with one bit per language.

A table of ``slots`` bit masks holds all languages' Bloom filters side by side: bit ``l`` of a mask
belongs to language ``l``, and a mask has as many 64-bit words as the languages need. An n-gram sets its language's bit in ``HASHES`` masks; the AND of these
masks returns, with one lookup, all languages that (as far as a Bloom filter knows) contain it. A
document's languages are counted bit by bit, each count is corrected for the false positives that
its filter's fill predicts, and the largest corrected share decides.

The filters are learnt from a sample of about ``rows_per_language`` training rows of each
language, so the broadcast table has ``slots`` masks (8 MB for every 64 languages) whatever the size of the corpus. No
language is left out; more than ``most_languages`` raise an error, since such a column hardly names languages. N-grams that few of a language's sampled texts hold are left
out: they are mostly other languages' words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import textarrays as ta
from .quality import held_out

UNDETERMINED = "und"
NGRAMS = (2, 3, 4)
SLICES = 64
_LETTER = regex.compile(r"\p{L}")


@dataclass(frozen=True)
class LanguageParams:
    """``share`` of a language's sampled texts (two at least) must hold an n-gram for it to enter the filter."""

    slots: int = 1 << 20
    rows_per_language: int = 400
    most_languages: int = 1024
    max_chars: int = 20_000
    share: float = 0.02


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    masks: np.ndarray
    false_positive: np.ndarray


def learn_sample(docs: DataFrame, folds: int, fold: int, params: LanguageParams, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> DataFrame:
    """``lang, text`` of the training rows: in each of ``SLICES`` hash slices of each language, those with the lowest hashed ids.

    Ids are ranked without their texts, and Spark drops what can't rank before the shuffle, so no task gets a
    language's rows. Of the texts of an id that repeats, the alphabetically first counts.
    """
    known = docs.select(F.col(doc_id).alias("_id"), F.col(lang).cast("string").alias("lang"), F.length(text).alias("_n"))
    known = known.where(F.col("_id").isNotNull() & F.col("lang").isNotNull() & (F.col("_n") > 0) & (F.col("_n") <= params.max_chars) & ~held_out(F.col("_id"), folds, fold)).select("_id", "lang")
    if known.select("lang").distinct().limit(params.most_languages + 1).count() > params.most_languages:
        raise ValueError(f"more than {params.most_languages} languages")
    ranked = known.withColumn("_h", F.xxhash64("_id"))
    slices = Window.partitionBy("lang", F.pmod("_h", F.lit(SLICES))).orderBy("_h", "_id")
    ranked = ranked.withColumn("_r", F.row_number().over(slices)).where(F.col("_r") <= -(-params.rows_per_language // SLICES))
    chosen = ranked.select("_id", "lang").distinct()  # most_languages x (rows_per_language + SLICES) rows at most
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("text")).join(F.broadcast(chosen), "_id").where((F.length("text") > 0) & (F.length("text") <= params.max_chars))
    return rows.groupBy("_id", "lang").agg(F.min("text").alias("text"))


def _slots(texts: list[str], size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each n-gram length: two slots of each occurrence and each text's range in them."""
    points, starts, ends = ta.code_points([f" {x.lower()} ".replace("\n", " ") for x in texts])
    for n in NGRAMS:
        one = ta.ngram_hashes(points, n)
        two = (one * np.uint32(0xC2B2AE35)) >> np.uint32(7)
        yield one & np.uint32(size - 1), two & np.uint32(size - 1), starts, np.maximum(starts, ends - (n - 1))


def learn(texts: list[str], langs: list[str], params: LanguageParams = LanguageParams()) -> LanguageModel:
    """Fill the filters; with nothing to learn from, the model knows no language."""
    names = tuple(sorted(set(langs)))
    masks = np.zeros((-(-len(names) // 64), params.slots), np.uint64)
    for k, name in enumerate(names):
        own = [x for x, y in zip(texts, langs) if y == name]
        held: list[np.ndarray] = []
        for text in own:
            held.append(np.unique(np.concatenate([(one[a[0] : b[0]].astype(np.uint64) << np.uint64(32)) | two[a[0] : b[0]] for one, two, a, b in _slots([text], params.slots)])))
        pairs, counts = np.unique(np.concatenate(held), return_counts=True)
        pairs = pairs[counts >= max(min(2, len(own)), params.share * len(own))]
        bit = np.uint64(1) << np.uint64(k % 64)
        masks[k // 64, (pairs >> np.uint64(32)).astype(np.int64)] |= bit
        masks[k // 64, (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)] |= bit
    fill = np.array([((masks[k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean() for k in range(len(names))])
    return LanguageModel(names, masks, fill**2)


def shares(texts: list[str], model: LanguageModel) -> np.ndarray:
    """For each text and language, the corrected share of the text's n-grams that the language contains."""
    out = np.zeros((len(texts), len(model.languages)))
    for at, chunk in ta.chunks(texts):
        total, part = np.zeros(len(chunk)), np.zeros((len(chunk), len(model.languages)))
        for one, two, a, b in _slots(chunk, model.masks.shape[-1]):
            total += b - a
            for word, masks in enumerate(model.masks):
                found = masks[one] & masks[two]
                for k in range(64 * word, min(64 * word + 64, len(model.languages))):
                    part[:, k] += ta.sums_by_text(((found >> np.uint64(k % 64)) & np.uint64(1)).astype(np.uint8), a, b)
        out[at : at + len(chunk)] = part / np.maximum(total, 1)[:, None]
    return np.clip((out - model.false_positive) / np.maximum(1 - model.false_positive, 1e-9), 0, 1)


def decide(texts: list[str | None], model: LanguageModel) -> tuple[list[str], np.ndarray]:
    """The language and a score in [0, 1] of each text: how far its share leads, among all shares."""
    found = shares([x or "" for x in texts], model)
    names, scores = [], np.zeros(len(texts))
    for i, text in enumerate(texts):
        if not text or not model.languages or not _LETTER.search(text):
            names.append(UNDETERMINED)
            continue
        k = int(found[i].argmax())  # of equal shares the alphabetically first language's
        others = np.delete(found[i], k)
        names.append(model.languages[k])
        scores[i] = found[i, k] / (found[i, k] + others.max(initial=0.0) + 1e-9)
    return names, scores


def identify(docs: DataFrame, sample: DataFrame, params: LanguageParams = LanguageParams(), text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of ``docs``, ``lang_pred`` and ``score``.

    Defined results: a text that is null or has no letter is ``und`` with score 0, as is every text
    if nothing was learnt; an empty table gives no rows; repeated rows are judged each time. Columns
    besides ``text`` and ``keep`` aren't read.
    """
    learned = sample.select("_id", "lang", "text").orderBy("lang", "_id", "text").toPandas()
    model = learn(learned["text"].tolist(), learned["lang"].tolist(), params)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = keep or ["doc_id"]
    sent = kept if text in kept else [*kept, text]  # a text that is kept goes to Python once
    rows, at = docs.select(*sent), sent.index(text)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(kept)]) + ", lang_pred string, score double"

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in ta.parts(batches):
            names, scores = decide(batch.column(at).to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*kept, "lang_pred", "score"])

    return rows.mapInArrow(judged, schema)
