"""Each operator against brute force on small fixtures, and on odd rows."""

import hashlib
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from normlake.llm import embeddings, language, packing, quality, rules, sharding, simhash, substring, toxicity
from normlake.llm import textarrays as ta
from normlake.llm.components import components
from normlake.llm.queries import QUERIES, tokenizer_path

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not Path(DATA).exists(), reason="needs the given tables")


def pairs_by(rows, *names):
    return {r[names[0]]: tuple(r[n] for n in names[1:]) for r in rows}


def union_find(ids, links):
    parent = {i: i for i in ids}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(7, 7), (None, 3)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 160), 100)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# 1 quality


def test_quality_learns_and_scores_odd_rows(spark, odd_docs, odd_labels, prose):
    rows = [(i, prose(i, 60), 1) if i % 2 else (i, "$$$ ".join(prose(i, 60).split()), 0) for i in range(80)]
    sample = spark.createDataFrame(rows, "_id long, text string, y int")
    scored = quality.score(odd_docs, sample, keep=["doc_id"]).collect()
    assert len(scored) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in scored)
    good = quality.score(spark.createDataFrame([(1, prose(501, 60)), (2, "$$$ ".join(prose(500, 60).split()))], "doc_id long, text string"), sample)
    by = {r["doc_id"]: r["score"] for r in good.collect()}
    assert by[1] > 0.5 > by[2]
    assert quality.score(odd_docs.limit(0), sample).count() == 0
    nothing = quality.labelled_sample(odd_docs, odd_labels.limit(0), "quality", 3, 1, 10, 1000)
    assert {round(r["score"], 6) for r in quality.score(odd_docs, nothing).collect()} == {0.5}


def test_training_rows_leave_the_held_out_fold_alone(spark, odd_docs, odd_labels):
    ids = {r["_id"] for r in quality.labelled_sample(odd_docs, odd_labels, "quality", 3, 1, 10, 10**6).collect()}
    assert ids == {i for i in (1, 2, 5) if zlib.crc32(str(i).encode()) % 3 != 1}
    held = {r[0]: r[1] for r in odd_docs.select("doc_id", quality.held_out(F.col("doc_id"), 3, 1)).collect()}
    assert held[None] is True and all(held[i] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in range(1, 11))


def test_quality_scores_do_not_depend_on_neighbours(prose):
    model = quality.train([prose(1, 30), "$$ " * 30], [1, 0])
    alone = quality.probabilities([prose(9, 50)], model)
    assert np.allclose(alone[0], quality.probabilities(["a", prose(9, 50), "", prose(3, 9)], model)[1])


def test_word_hashes_of_texts_beyond_a_chunk():
    words = [f"w{i % 5000}" for i in range(400_000)] + ["x" * (2 * ta.CHUNK)] * 2 + ["w1"]
    points, _, _ = ta.code_points([" ".join(words)])
    first, last = ta.word_bounds(points)
    hashes = ta.word_hashes(points, first, last)
    assert len(hashes) == len(words) and (hashes[5000:400_000] == hashes[: 395_000]).all() and hashes[-1] == hashes[1] and hashes[-2] == hashes[-3]
    assert len(np.unique(hashes)) == 5001 and len(ta._powers) <= 2 * ta.CHUNK + 2


# 2 SimHash


def brute_print(text, width=4):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] if len(words) >= width else [b" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_match_the_definition(prose):
    texts = ["", "One two", "a b c d", prose(5, 700), "Éa ÉA b c d e", "x\x0by\x0cz\x1cq w"]
    assert [int(x) for x in simhash.fingerprints([t.encode() for t in texts])] == [brute_print(t) for t in texts]


def test_spark_hash_is_the_same_hash(spark):
    row = spark.range(1).select(F.xxhash64(F.lit("the end of it"))).first()[0]
    assert row % (1 << 64) == xxhash.xxh64_intdigest(b"the end of it", 42)


@pytest.mark.parametrize("most", [4096, 8])
def test_links_are_complete_in_whole_and_split_shards(spark, most):
    random = np.random.default_rng(3)
    base = [int(x) for x in random.integers(0, 1 << 63, 12)]
    prints = sorted({b ^ sum(1 << int(k) for k in random.choice(64, random.integers(0, 4), replace=False)) for b in base for _ in range(14)})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = [(a, b) for i, a in enumerate(signed) for b in signed[:i] if bin((a ^ b) & ((1 << 64) - 1)).count("1") <= 4]
    want = union_find(signed, links)
    found = simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"), most_in_tree=most)
    assert union_find(signed, [(r["a"], r["b"]) for r in found.collect()]) == want


def test_bk_tree_finds_all_within_the_radius():
    random, tree = np.random.default_rng(4), simhash.BKTree()
    values = [int(x) for x in random.integers(0, 1 << 12, 300)]
    for v in values:
        tree.add(v)
    for q in values[:40]:
        assert Counter(tree.within(q, 2)) == Counter(v for v in values if (v ^ q).bit_count() <= 2)


def test_near_duplicates_of_odd_rows(spark, odd_docs):
    found = simhash.near_duplicates(odd_docs).collect()
    assert len(found) == odd_docs.count()
    by = pairs_by(found, "doc_id", "fingerprint", "component_id")
    assert by[1] == by[2] and by[1][1] == 1
    assert by[3] == by[4] == by[7] == ("0" * 16, 3)
    texts = {r["doc_id"]: r["text"] for r in odd_docs.collect()}
    assert all(int(by[i][0], 16) == brute_print(texts[i]) for i in texts)
    assert simhash.near_duplicates(odd_docs.limit(0)).count() == 0


# 4 toxicity


def test_toxicity_finds_the_words_that_only_toxic_texts_hold(spark, odd_docs, prose):
    bad = ["vilest", "wretched", "nastiness"]
    texts = [prose(i, 90) for i in range(120)]
    rows = [(i, t, 0) if i % 2 else (i, " ".join(w if j % 11 else bad[(i + j) % 3] for j, w in enumerate(t.split())), 1) for i, t in enumerate(texts)]
    sample = spark.createDataFrame(rows, "_id long, text string, y int")
    tests = [(i, " ".join(bad[j % 3] if i % 2 and j % 11 == 0 else w for j, w in enumerate(prose(i, 90).split()))) for i in range(300, 330)]
    by = {r["doc_id"]: r["score"] for r in toxicity.score(spark.createDataFrame(tests, "doc_id long, text string"), sample, 0.5).collect()}
    assert sum((by[i] >= 0.3) == (i % 2 == 1) for i in by) >= 27
    assert toxicity.score(odd_docs, sample, 0.5).count() == odd_docs.count()
    assert {round(r["score"], 9) for r in toxicity.score(odd_docs, sample.where("y = 0"), 0.25).collect()} == {0.25}
    assert toxicity.score(odd_docs.limit(0), sample, 0.5).count() == 0


def test_toxicity_learns_words_beside_a_much_more_frequent_one(prose):
    bad = ["wretched", "nastiness", "loathsome"]

    def put(text, i, *new):
        words = text.split()
        for k, w in enumerate(new):
            words.insert((7 * i + 23 * k) % len(words), w)
        return " ".join(words)

    texts = [prose(i, 60) for i in range(1000)]
    toxic = [put(t, i, *["vilest"] * bool(i % 5), *[w for k, w in enumerate(bad) if i % 8 == k]) for i, t in enumerate(texts[:500])]
    model = toxicity.train(texts[500:] + toxic, [0] * 500 + [1] * 500, 0.5)
    pair = toxicity._pair(model)
    saved = {w: toxicity.savings(f"thesofer {w} andreingth tionerhe", model.words, pair).sum() for w in ["vilest", *bad]}
    assert sum(x > 0 for x in saved.values()) >= 3 and toxicity.savings(prose(7000, 600), model.words, pair).sum() <= 30
    scores = toxicity.rate([put(prose(2000 + i, 60), i, *["vilest", "wretched"] * (i % 2)) for i in range(200)], model)
    assert sum((x >= 0.3) == bool(i % 2) for i, x in enumerate(scores)) >= 170


def test_toxicity_equals_a_plain_loop_of_compressions(prose):
    import zstandard

    texts = [prose(i, 80) + (" vilest nastiness" if i % 2 else "") for i in range(200)]
    model = toxicity.train(texts, [i % 2 for i in range(200)], 0.5)

    def size(content, window):
        options = zstandard.ZstdCompressionParameters(window_log=20, hash_log=18, chain_log=18, search_log=4, min_match=5, target_length=32, strategy=zstandard.STRATEGY_BTLAZY2, write_content_size=False, write_checksum=False, write_dict_id=False)
        data = zstandard.ZstdCompressionDict(model.tables + content, dict_type=zstandard.DICT_TYPE_FULLDICT if model.tables else zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(compression_params=options, dict_data=data).compress(window))

    for text in ("", " vilest \n", prose(900, 41) + " VILEST", "é" * 300):
        words = text.encode().lower().split()
        weight, n = 0.0, 0
        for i in range(0, len(words), 6):
            window = b" " + b" ".join(words[i : i + 6]) + b" "
            saved = size(model.ordinary, window) - size(model.toxic + model.ordinary, window)
            weight, n = weight + model.levels[min(max(saved, -3), 10) + 3], n + 1
        a, b, c, d = model.logistic
        want = 1 / (1 + np.exp(-(a * weight + b * weight / max(n, 1) ** 0.5 + c * np.log1p(n) + d)))
        assert toxicity.rate([text], model)[0] == pytest.approx(want)
    assert toxicity.rate([None], model) == toxicity.rate([""], model)


def test_toxicity_windows_of_a_long_text_go_on_across_blocks():
    text = " ".join(f"w{i}" for i in range(2 * toxicity.BLOCK + 7))
    words = text.encode().split()
    assert list(toxicity.windows(text, 6)) == [b" " + b" ".join(words[i : i + 6]) + b" " for i in range(0, len(words), 6)]


def test_a_repeated_id_gives_one_training_row(spark, prose):
    docs = spark.createDataFrame([(1, prose(i % 7, 5)) for i in range(10_000)] + [(2, "b")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    found = quality.labelled_sample(docs, labels, "quality", 3, 5, 10, 1000).collect()
    assert sorted((r["_id"], r["text"], r["y"]) for r in found) == [(1, min(prose(i, 5) for i in range(7)), 1), (2, "b", 0)]


# 5 packing


def test_best_fit_is_gapless_and_tight():
    sizes = [int(x) for x in np.random.default_rng(1).integers(1, 100, 500)]
    bins = packing.best_fit(sizes, 128)
    assert sorted(i for b in bins for i in b) == list(range(500)) and all(sum(sizes[i] for i in b) <= 128 for b in bins)
    assert len(bins) <= 1.03 * sum(sizes) / 128 + 1
    assert sum(sum(sizes[i] for i in b) <= 64 for b in bins) <= 1


@pytest.mark.parametrize("params", [packing.PackParams(), packing.PackParams(leaf=3, fan_in=2, carry=2, slack=1)])
def test_packing_of_odd_rows(spark, odd_docs, params):
    found = packing.pack_documents(odd_docs, tokenizer_path("byte_bpe_50k.json"), params).toPandas()
    assert found.doc_id.isna().sum() == 1 and len(set(found.doc_id.dropna())) == 10
    placed = found.sort_values(["sequence_id", "offset"])
    assert (placed.groupby("sequence_id").length.cumsum() - placed.length == placed.offset).all()
    assert placed.groupby("sequence_id").length.sum().max() <= params.capacity
    long = found[found.doc_id == 5].sort_values("piece")
    assert (long.length.iloc[1:] == params.capacity).all() and list(long.start) == list(long.length.cumsum() - long.length)
    assert found[found.doc_id == 3].ids_crc32.iloc[0] == zlib.crc32(bytes(4)) and len(found[found.doc_id == 2]) == 2
    assert packing.pack_documents(odd_docs.limit(0), tokenizer_path("byte_bpe_50k.json"), params).count() == 0


# 6 sharding


def test_hilbert_neighbours_touch_and_cells_are_unique(spark):
    cells = spark.range(16).select(F.col("id").alias("x")).crossJoin(spark.range(16).select(F.col("id").alias("y")))
    rows = sharding.with_hilbert_index(cells.selectExpr("x", "y", "x as a", "y as b"), ["a", "b"], 4, "h").orderBy("h").collect()
    assert [r["h"] for r in rows] == list(range(256))
    assert all(abs(a["x"] - b["x"]) + abs(a["y"] - b["y"]) == 1 for a, b in zip(rows, rows[1:]))


def test_shards_of_odd_rows(spark, odd_docs):
    found = sharding.shard_by_curve(odd_docs, shards=5).toPandas()
    counts = found.groupby("shard").size()
    assert len(found) == odd_docs.count() and counts.max() - counts.min() <= 1 and set(counts.index) == set(range(5))
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in found.groupby("shard"))
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in odd_docs.where("doc_id is not null").collect()}
    assert all((r["size"], r["text_crc32"]) == (len(texts[r["doc_id"]]) + 1, zlib.crc32(texts[r["doc_id"]])) for _, r in found[found.doc_id.notna()].iterrows())
    assert sharding.shard_by_curve(odd_docs.limit(0)).count() == 0


# 7 embeddings


def test_range_join_against_brute_force(spark):
    random = np.random.default_rng(2)
    centres = random.normal(size=(12, 8))
    rows = [(i, [float(v) for v in centres[i % 12] + random.normal(size=8) * (0.02 if i % 3 else 0.3)]) for i in range(150)]
    rows += [(200, rows[0][1]), (201, rows[0][1]), (201, rows[0][1]), (202, None), (203, [0.0] * 8), (204, [1.0, None] + [0.0] * 6), (205, [float("nan")] * 8), (206, rows[5][1][:4]), (207, [2 * v for v in rows[5][1][:4]]), (None, rows[1][1]), (208, [])]
    table = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, v string, node int")
    table_rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    good = [(k, i, np.array(v, float)) for k, (i, v) in enumerate(table_rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = [(a[0], b[0]) for a in good for b in good if a[0] != b[0] and len(a[2]) == len(b[2]) and a[2] @ b[2] / np.linalg.norm(a[2]) / np.linalg.norm(b[2]) >= 0.95]
    group = union_find(range(len(table_rows)), [p for p in links if p[0] < p[1]])
    n = Counter(a for a, _ in links)
    want = Counter()
    for k, (i, _) in enumerate(table_rows):
        least = min((table_rows[m][0] for m in group if group[m] == group[k] and table_rows[m][0] is not None), default=None)
        want[(i, n[k], least, i is not None and i == least)] += 1
    for params in (embeddings.JoinParams(pivots=5), embeddings.JoinParams(pivots=5, most=7)):
        found = Counter(tuple(r) for r in embeddings.near_duplicates(table, params).select("vec_id", "n_links", "component_id", "kept").collect())
        assert found == want
    assert embeddings.near_duplicates(table.limit(0)).count() == 0


# 8 language


def test_language_of_odd_rows(spark, odd_docs, prose):
    sample = spark.createDataFrame([(i, "aa" if i % 2 else "bb", prose(i, 50) if i % 2 else "quox zyvv wekk jubb " * 10) for i in range(40)], "_id long, lang string, text string")
    found = pairs_by(language.identify(odd_docs, sample).collect(), "doc_id", "lang_pred", "score")
    assert found[1][0] == "aa" and found[3] == found[4] == found[6] == found[7] == ("und", 0.0)
    assert language.identify(odd_docs, sample).count() == odd_docs.count()
    model = language.learn(["aaaa bbbb", "zzzz yyyy"], ["l1", "l2"])
    assert language.decide(["bbbb", "yyyy", "a"], model)[0] == ["l1", "l2", "l1"]
    assert {r["lang_pred"] for r in language.identify(odd_docs, sample.limit(0)).collect()} == {"und"}
    chosen = language.learn_sample(odd_docs, 3, 1, language.LanguageParams(max_chars=10**6))
    assert all(zlib.crc32(str(r["_id"]).encode()) % 3 != 1 and r["text"] for r in chosen.collect())
    assert language.identify(odd_docs.limit(0), sample).count() == 0


def test_more_languages_than_one_mask_word_has_bits(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    names = {f"l{i:02}": " ".join(letters[(i * 7 + j * (1 + i // 26)) % 26] + letters[(i + 3 * j) % 26] + letters[(i * i + j) % 26] for j in range(25)) for i in range(70)}
    rows = [(i, lang, text) for i, (lang, text) in enumerate([*names.items(), *names.items()])]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    params = language.LanguageParams(slots=1 << 16)
    found = language.identify(docs, docs.withColumnRenamed("doc_id", "_id"), params, keep=["doc_id", "lang"]).collect()
    assert len(found) == 140 and all(r["lang"] == r["lang_pred"] for r in found)
    assert {r["lang"] for r in language.learn_sample(docs, 3, 3, params).collect()} == set(names)
    with pytest.raises(ValueError, match="languages"):
        language.learn_sample(docs, 3, 3, language.LanguageParams(most_languages=69))


def test_language_sample_of_one_id_ten_thousand_times(spark, prose):
    docs = spark.createDataFrame([(1, "en", prose(i % 9, 5)) for i in range(10_000)], "doc_id long, lang string, text string")
    assert [r["text"] for r in language.learn_sample(docs, 3, 3, language.LanguageParams()).collect()] == [min(prose(i, 5) for i in range(9))]


# 9 substring


def brute_repeats(rows, width=13):
    first = {}
    for i, t in rows:
        w = (t or "").encode().split()
        if i is not None:
            for j in range(len(w) - width + 1):
                k = tuple(w[j : j + width])
                first[k] = min(first.get(k, i), i)
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = set()
        for j in range(len(w) - width + 1):
            if i is not None and first[tuple(w[j : j + width])] < i:
                gone |= set(range(j, j + width))
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def cut(df, params=substring.RepeatParams()):
    return Counter(tuple(r) for r in substring.remove_repeats(df, params).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect())


@pytest.mark.parametrize("params", [substring.RepeatParams(), substring.RepeatParams(hot_least=1, most_hot=10**9, index_bytes=300, bitmap_bits=256)])
def test_repeats_against_brute_force(spark, odd_docs, prose, params):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert cut(odd_docs, params) == brute_repeats(rows)
    shared = [prose(900 + k, 13 + k) for k in range(4)]
    made = [(i, " ".join([prose(i, 20), shared[i % 4], "le " * (i % 40), shared[(i + 1) % 4][: 60 + i]])) for i in range(60)]
    assert cut(spark.createDataFrame(made, "doc_id long, text string"), params) == brute_repeats(made)
    assert cut(odd_docs.limit(0), params) == Counter()


def test_backward_search_counts_every_pattern():
    random = np.random.default_rng(5)
    symbols = np.append(random.integers(1, 4, 400), 0)
    index = substring.FMIndex(symbols, 4)
    starts = np.arange(380)
    low, high = index.search(symbols, starts, 5)
    text = symbols.tolist()
    for s in starts.tolist():
        n = sum(text[k : k + 5] == text[s : s + 5] for k in range(396))
        assert high[s] - low[s] == n or (n == 1 and high[s] - low[s] == 1)


# 10 quality rules


def test_base_counts_and_verdicts_of_odd_rows(spark, odd_docs, prose):
    extra = [(20, "a b c a b c\n\n  \na b\nx\nx\nx #$ " + prose(3, 60)), (21, "z " * 60), (22, "é|<>日本 " * 3)]
    table = odd_docs.select("doc_id", "text", "kept").unionByName(spark.createDataFrame([(*r, "k") for r in extra], "doc_id long, text string, kept string"))
    found = rules.judge(table, spark.createDataFrame([(1,), (None,)], "doc_id long"))
    assert found.count() == table.count()
    for r in found.join(table.select("doc_id", "text"), "doc_id").collect():
        text = r["text"] or ""
        words = [w.decode() for w in text.encode().split()]
        runs = [tuple(words[j : j + 3]) for j in range(len(words) - 2)]
        again = {j + k for j, run in enumerate(runs) if runs.count(run) > 1 for k in range(3)} if len(words) < 5000 else None
        lines = [x for x in text.split("\n") if x.encode().split()]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"]) == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)))
        if again is not None:
            assert r["n_repeat_words"] == len(again)
            assert r["base_failed"] == (len(words) < 50 or 100 * len(again) > 50 * len(words))
        assert not (r["kept"] and r["base_failed"])
    assert rules.judge(odd_docs.limit(0), spark.createDataFrame([], "doc_id long")).count() == 0


def test_ratio_against_plain_counts(spark, prose):
    params = rules.RuleParams(buckets=64, threshold=-0.01)
    texts = {i: prose(i, 55 + i) if i < 6 else " ".join(w if j % 3 else "spam" for j, w in enumerate(prose(i, 60).split())) for i in range(12)} | {12: "", 13: None}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = rules.judge(docs, spark.createDataFrame([(0,), (1,), (2,), (99,)], "doc_id long"), params).collect()

    def buckets(text):
        words = (text or "").encode().split()
        single = [xxhash.xxh64_intdigest(w, 42) for w in words]
        return [h % 64 for h in single + [xxhash.xxh64_intdigest(w, h) for w, h in zip(words[1:], single)]]

    raw, target = Counter(b for t in texts.values() for b in buckets(t)), Counter(b for i in range(3) for b in buckets(texts[i]))
    ratio = {b: np.log((target[b] + 1) / (target.total() + 64)) - np.log((raw[b] + 1) / (raw.total() + 64)) for b in range(64)}
    for r in found:
        own = buckets(texts[r["doc_id"]])
        want = sum(ratio[b] for b in own) / len(own) if own else 0.0
        assert r["ratio"] == pytest.approx(want, abs=1e-12) and r["kept"] == (not r["base_failed"] and want >= params.threshold)


@needs_data
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_return_every_row(spark, name):
    found = QUERIES[name](spark, DATA)
    table = "embeddings" if name.startswith("op7") else "documents"
    assert found.count() >= spark.read.parquet(f"{DATA}/{table}.parquet").count()
