"""Fingerprints, ranked search and the Merkle manifest against plain loops, and on odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from normlake.llm import merkle, ranked, rarity

draw = random.Random(5)


# 11 fingerprints


def test_entropy_levels_are_those_of_counts():
    values = np.array([draw.choice(b"aaab c d") for _ in range(700)], np.uint8)
    found = rarity.entropies(values)
    for i in range(0, len(found), 7):
        counts = Counter(values[i : i + rarity.WINDOW].tolist()).values()
        plain = -sum(c / rarity.WINDOW * math.log2(c / rarity.WINDOW) for c in counts) / math.log2(rarity.WINDOW)
        assert abs(1000 * plain - found[i]) <= 1.001
    assert len(rarity.entropies(values[: rarity.WINDOW - 1])) == 0


def plain_features(text, rank):
    """The windows that a text's runs choose, one window and one run at a time."""
    w = rarity.WINDOW
    values = np.frombuffer(text, np.uint8)
    if len(text) < w:
        return [text] if text else []
    order = [rank[rarity.entropies(values[i : i + w])[0]] for i in range(len(text) - w + 1)]
    if len(order) <= rarity.PER_FILTER:
        chosen = range(len(order))
    else:
        votes = Counter(min(range(s, s + rarity.RUN), key=lambda i: (order[i], i)) for s in range(len(order) - rarity.RUN + 1))
        chosen = sorted(i for i, v in votes.items() if v >= min(rarity.VOTES, max(votes.values())))
    return list(dict.fromkeys(text[i : i + w] for i in chosen))


def test_features_are_those_of_a_plain_loop(monkeypatch, prose):
    texts = [b"", b"short", b"x" * 400, *[prose(i, 5 + 9 * i).encode() for i in range(14)], "日本 ünï ".encode() * 60]
    rank = rarity.ranks(rarity.histogram(texts))
    whole = rarity.fingerprints(texts, rank)
    for text, found in zip(texts, whole):
        features = plain_features(text, rank)
        assert len(found) == -(-len(features) // rarity.PER_FILTER)
        # A filter of m features has 5 m bits at most, and not many fewer.
        for k, one in enumerate(found):
            m = len(features[k * rarity.PER_FILTER : (k + 1) * rarity.PER_FILTER])
            assert 0.75 * 5 * m < np.unpackbits(one).sum() <= 5 * m
        alone = rarity.fingerprints([text], rank)[0]
        assert (alone == found).all() and rarity.likeness(alone, found) == 1
    monkeypatch.setattr(rarity, "SEGMENT", 97)  # segments change nothing
    assert all((a == b).all() for a, b in zip(whole, rarity.fingerprints(texts, rank)))
    assert rarity.likeness(whole[0], whole[1]) == 0 and rarity.likeness(whole[0], whole[0]) == 1


def test_neighbours_and_edits(spark, odd_docs):
    def check(docs):
        rows = sorted(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t")).collect(), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
        expected = []
        for i, (doc_id, text) in enumerate(rows):
            after = rows[(i + 1) % len(rows)][1]
            third = len(text) // 3
            expected.append((doc_id, len(text), hashlib.sha256((text[: len(text) - third] + after[:third]).encode()).hexdigest()))
        found = rarity.compare(docs).collect()
        assert sorted(map(str, expected)) == sorted(str((r["doc_id"], r["n_chars"], r["edited_sha256"])) for r in found)
        return found

    found = check(odd_docs)
    prints = {}
    for r in found:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        prints.setdefault((r["doc_id"], r["n_chars"]), set()).add(r["fingerprint"])
    assert all(len(p) == 1 for p in prints.values())
    assert len({r["fingerprint"] for r in found if r["doc_id"] in (1, 2)}) == 1  # equal texts
    many = spark.range(300).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.sha2(F.col("id").cast("string"), 256), F.sha2((F.col("id") * 7).cast("string"), 256), F.lit("tail")).alias("text"))
    found = check(many)
    assert np.mean([r["near_edited"] for r in found]) > 0.5 > 0.1 > np.mean([r["near_next"] for r in found])
    check(many.limit(1))
    check(many.where("doc_id < 2"))
    assert rarity.compare(odd_docs.limit(0)).count() == 0


# 12 ranked search


def plain_search(docs, items, k):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    split = lambda t: pattern.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    held = [(i, Counter(w), len(w)) for i, t in docs if (w := split(t))]
    n, length = len(held), sum(x[2] for x in held)
    df = Counter(t for x in held for t in x[1])
    out = []
    for item, text in items:
        scores = []
        for i, tf, size in held:
            m = 75 + (25 * size * n) // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * tf[t]) // (1000 * tf[t] + 12 * m)) for t in split(text) if t in df)
            if s > 0:
                scores.append((-s, (i is not None, i or 0), i))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(scores)[:k], 1)]
    return out


def found_rows(rows):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in rows), key=str)


def test_search_is_exact_on_odd_rows(spark, odd_docs, prose):
    items = [(1, prose(1, 12)), (2, "The END the"), (3, None), (4, ""), (5, "ÜNÏCODE ünïcode 日本"), (None, "changed"), (7, prose(3, 40) + " the end"), (7, prose(3, 40) + " the end"), (8, "absent")]
    table = spark.createDataFrame(items, "item_id long, text string").withColumn("score", F.lit("x"))
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.select("doc_id", "text").collect()]
    for k in (1, 3, 20):
        assert found_rows(ranked.search(odd_docs, table, k).collect()) == sorted(plain_search(docs, items, k), key=str)
    assert ranked.search(odd_docs.limit(0), table).count() == 0 == ranked.search(odd_docs, table.limit(0)).count()


@pytest.mark.parametrize("postings", [1, 60, 1 << 21])
def test_blocks_and_item_blocks_change_nothing(spark, monkeypatch, postings):
    words = [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(draw.choices(words, [1 / (i + 1) for i in range(60)], k=n))
    docs = [(i, text(draw.randrange(1, 60))) for i in range(400)]
    items = [(i, text(8)) for i in range(30)]
    monkeypatch.setattr(ranked, "POSTINGS", postings)
    monkeypatch.setattr(ranked, "MOST_ITEMS", 20)
    found = ranked.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), 5)
    assert found_rows(found.collect()) == sorted(plain_search(docs, items, 5), key=str)


def test_accumulators_are_limited():
    """Once the remaining bounds are too low, postings of common terms create none."""
    numbers = {b"rare": 0, b"common": 1}
    queries = ranked.Queries([0], numbers, [Counter({0: 1, 1: 1})], np.array([5000, 10]), np.array([30, 900]), np.array([5000 * 500_000, 10 * 500_000]))
    own = ranked.Evaluator(queries, 1000, 10_000, 20)
    sizes = np.where(np.arange(930) < 30, 2, 1)
    found = np.concatenate([np.tile([0, 1], 30), np.ones(900, np.int64)])
    own.block(np.arange(930), np.full(930, 10), sizes, found, np.ones(960, np.int64))
    assert own.created == 30 and own.postings == 960
    assert own.best[0][1].tolist() == list(range(20)) and (own.best[0][0] > 5000 * 400_000).all()


# 13 Merkle manifest


def plain_manifest(rows):
    sha = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()
    shown = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    lower = lambda t: t and "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([sha(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
        return out

    def steps(tree, i):
        for level in tree[:-1]:
            yield i % 8, level[i // 8 * 8 : i // 8 * 8 + 8]
            i //= 8

    leaf = lambda r, text: sha(*map(shown, (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))
    langs = sorted({r["lang"] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        own = sorted((r for r in rows if r["lang"] == lang), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
        trees[lang] = own, levels([leaf(r, r["text"]) for r in own])
    top = levels([trees[x][1][-1][0] for x in langs])
    out = []
    for k, lang in enumerate(langs):
        own, tree = trees[lang]
        for i, r in enumerate(own):
            path = [*steps(tree, i), *steps(top, k)]
            hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
            h = leaf(r, lower(r["text"]) if hit else r["text"])
            for at, run in path:
                h = sha(*[h if j == at else x for j, x in enumerate(run)])
            others = [x for at, run in path for j, x in enumerate(run) if j != at]
            out.append((r["doc_id"], tree[0][i], tree[-1][0], top[-1][0], sha(*others), h, h == top[-1][0]))
    return sorted(out, key=str)


def test_manifest_of_odd_rows(spark, odd_docs):
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    for docs in (odd_docs, odd_docs.limit(1), odd_docs.where("lang = 'fr'")):
        rows = docs.select(columns).collect()
        assert sorted(map(tuple, merkle.verify(docs).collect()), key=str) == plain_manifest(rows)
    assert merkle.verify(odd_docs.limit(0)).count() == 0


@pytest.mark.parametrize("n", [7, 8, 9, 64, 65, 513, 4200])
def test_manifest_over_several_levels_of_blocks(spark, n):
    lang = F.when(F.col("id") % 3 > 0, "en").when(F.col("id") == 0, "de")
    docs = spark.range(n).select((F.col("id") * 7 % n).alias("doc_id"), F.concat(F.lit("Text É "), "id").alias("text"), lang.alias("lang"), F.lit("s").alias("source"), F.lit(None).cast("long").alias("n_chars"))
    assert sorted(map(tuple, merkle.verify(docs).collect()), key=str) == plain_manifest(docs.collect())


def test_tampering_is_found(spark):
    docs = spark.createDataFrame([(i, "ABC" if i % 2 else "abc", "en", "s", 3) for i in range(30)], "doc_id long, text string, lang string, source string, n_chars long")
    for r in merkle.verify(docs).collect():
        assert r["verified"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 != 0 or r["doc_id"] % 2 == 0)
