"""The pipeline's near-duplicates against all pairs' exact similarities."""

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from normlake.llm import jaccard, simhash

from .conftest import sentence


def edited(seed: int, places: list[int]) -> str:
    words = sentence(seed, 120).split()
    return " ".join(f"edit{p}" if p in places else w for p, w in enumerate(words))


def test_stage_drops_pairs_beyond_four_bits(spark):
    texts = {i: edited(i, []) for i in range(20)} | {100 + i: edited(i, [30 + i, 80]) for i in range(20)} | {200: edited(3, list(range(5, 120, 12)))}
    prints = simhash.fingerprints([texts[k].encode() for k in (*range(20), *range(100, 120))], 5)
    assert (np.bitwise_count(prints[:20] ^ prints[20:]) > 4).sum() >= 15  # these were kept
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    stay = {r["doc_id"] for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()}
    assert stay == {*range(20), 200}


@pytest.mark.parametrize("most", [1 << 20, 700])
def test_components_are_those_of_all_similar_pairs(spark, most):
    random = np.random.default_rng(5)
    texts = {i: edited(i % 6, sorted(int(x) for x in random.choice(120, random.integers(0, 4), replace=False))) for i in range(90)}
    sets = {k: jaccard.shingle_set(t.encode(), 5) for k, t in texts.items()}
    roots = {k: k for k in texts}
    for a in texts:
        for b in range(a):
            if len(np.intersect1d(sets[a], sets[b])) / len(np.union1d(sets[a], sets[b])) >= 0.8:
                old, new = max(roots[a], roots[b]), min(roots[a], roots[b])
                roots = {k: new if r == old else r for k, r in roots.items()}
    found = jaccard.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), most_shingles=most).collect()
    groups = {}
    for r in found:
        groups.setdefault(r["root"], set()).add(r["doc_id"])
    want = {}
    for k, r in roots.items():
        want.setdefault(r, set()).add(k)
    assert {frozenset(g) for g in groups.values()} == {frozenset(g) for g in want.values()}


def test_neighbours_are_the_same_wherever_batches_end():
    random = np.random.default_rng(7)
    key, n = np.sort(random.integers(0, 9, 60)), random.integers(1, 12, 60)
    order = np.lexsort((n, key))
    key, n, node = key[order], n[order], np.arange(60)
    num, den = jaccard.LEAST
    want = {(i, j) for i in range(60) for j in range(i + 1, min(i + jaccard.REACH, 59) + 1) if key[i] == key[j] and n[j] * num <= n[i] * den}
    for size in (1, 2, 3, 7, 59, 10_000):
        batches = [pa.RecordBatch.from_arrays([pa.array(x[i : i + size]) for x in (key, n, node)], ["key", "n", "set_id"]) for i in range(0, 60, size)]
        found = [p for out in jaccard._neighbours(iter(batches)) for p in zip(out.column(0).to_pylist(), out.column(1).to_pylist())]
        assert len(found) == len(want) and set(found) == want
