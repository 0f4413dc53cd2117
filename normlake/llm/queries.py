"""The registered queries of the training-data operators, over the whole tables of a folder."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embeddings, language, merkle, packing, quality, ranked, rarity, rules, sharding, simhash, substring, tokens, toxicity


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer's file on this machine (the tokenizers' package is on every executor)."""
    return importlib.import_module("public_tokenizers").path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels, params = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), quality.QualityParams()
    sample = quality.labelled_sample(docs, labels, "quality", 3, 1, params.rows_per_class, params.max_chars)
    scored = quality.score(docs, sample, params)
    return scored.select("doc_id", quality.held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), width=4, radius=4)


def op3_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.digests(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels, params = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), toxicity.ToxicityParams()
    sample = quality.labelled_sample(docs, labels, "toxic", 4, 2, params.rows_per_class, params.max_chars)
    scored = toxicity.score(docs, sample, toxicity.prior(labels, "toxic", 4, 2), params)
    return scored.select("doc_id", quality.held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op6_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_curve(_table(spark, sf_dir, "documents")).drop("curve")


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, params = _table(spark, sf_dir, "documents"), language.LanguageParams()
    judged = language.identify(docs, language.learn_sample(docs, 3, 1, params), params)
    return judged.select("doc_id", quality.held_out(F.col("doc_id"), 3, 1).alias("held_out"), "lang_pred", "score")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring.remove_repeats(_table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.judge(_table(spark, sf_dir, "documents"), rules.target_ids(_table(spark, sf_dir, "labels")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio")


def op11_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rarity.compare(_table(spark, sf_dir, "documents"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), 20)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_bpe_encode_decode": op3_bpe_encode_decode,
    "op4_toxicity": op4_toxicity,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_hilbert_sharding": op6_hilbert_sharding,
    "op7_embedding_near_dedup": op7_embedding_near_dedup,
    "op8_language_id": op8_language_id,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_quality_rules": op10_quality_rules,
    "op11_document_fingerprints": op11_document_fingerprints,
    "op12_ranked_search": op12_ranked_search,
    "op13_merkle_manifest": op13_merkle_manifest,
}
_FIELD = "coalesce(strlen({0}::varchar) || ':' || {0}::varchar, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"
#: CRC-32 of a decimal number: each of its digits' codes is an element to take in, each -1 one of its eight steps.
_CRC = "xor(list_reduce(flatten(list_transform(string_split(doc_id::varchar, ''), lambda c: [ascii(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1])), lambda r, x: CASE WHEN x >= 0 THEN xor(r, x) ELSE xor(r >> 1, (r & 1) * 3988292384) END, 4294967295::bigint), 4294967295)"


def _tree(name: str, leaves: str) -> str:
    """Every node ``g, level, i, h, c`` (c: nodes of its level) over ``leaves`` of ``g, i, h``."""
    return f"""{name}0 AS (SELECT g, 0 AS level, i, h FROM {leaves} UNION ALL SELECT g, level + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, count(*) OVER (PARTITION BY g) AS c FROM {name}0) WHERE c > 1 GROUP BY g, level, i // 8),
      {name} AS (SELECT *, count(*) OVER (PARTITION BY g, level) AS c FROM {name}0), {name}r AS (SELECT g, level, i // 8 AS run, list(h ORDER BY i) AS hs FROM {name} WHERE c > 1 GROUP BY g, level, i // 8)"""


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
_WORDS = r"[^\x20\x09-\x0D]+"
#: SQL for the operators that it can express; the others need XXH64, CRC-32, a tokenizer or a learned model.
ORACLES: dict[str, str] = {
    "op12_ranked_search": f"""WITH d AS (SELECT doc_id, {_TERMS} AS w FROM documents WHERE text IS NOT NULL), e AS (SELECT doc_id, w, len(w) AS n FROM d WHERE len(w) > 0), s AS (SELECT count(*) AS docs, sum(n)::bigint AS terms FROM e),
      p AS (SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, n, unnest(w) AS t FROM e) GROUP BY doc_id, n, t), f AS (SELECT t, count(*) AS df FROM p GROUP BY t),
      q AS (SELECT item_id, t, count(*) AS c FROM (SELECT item_id, unnest({_TERMS}) AS t FROM benchmark) GROUP BY item_id, t),
      x AS (SELECT item_id, doc_id, sum(c * floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::bigint * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms))))::bigint AS score FROM q JOIN p USING (t) JOIN f USING (t), s GROUP BY item_id, doc_id),
      r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM x WHERE score > 0)
      SELECT item_id, rank::int AS rank, doc_id, score FROM r WHERE rank <= 20""",
    "op13_merkle_manifest": f"""WITH RECURSIVE d AS (SELECT doc_id, coalesce('1' || lang, '') AS g, {_LEAF.format(text='text')} AS leaf, CASE WHEN {_CRC} % 3 = 0 THEN {_LEAF.format(text="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ELSE {_LEAF.format(text='text')} END AS changed FROM documents),
      l AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, leaf AS h FROM d), {_tree('n', 'l')},
      s AS (SELECT g AS sub, 0 AS g, row_number() OVER (ORDER BY g) - 1 AS i, h FROM n WHERE c = 1), {_tree('m', 's')}, t AS (SELECT h AS root FROM m WHERE c = 1),
      p AS (SELECT doc_id, leaf, changed, l.i, s.h AS subroot, nr.level, hs, l.i // (8 ** nr.level)::bigint % 8 AS place FROM l JOIN s ON sub = l.g LEFT JOIN nr ON nr.g = l.g AND run = l.i // (8 ** (nr.level + 1))::bigint
        UNION ALL SELECT doc_id, leaf, changed, l.i, s.h, mr.level + 100, hs, s.i // (8 ** mr.level)::bigint % 8 FROM l JOIN s ON sub = l.g LEFT JOIN mr ON run = s.i // (8 ** (mr.level + 1))::bigint),
      e AS (SELECT *, array_to_string(hs[1:place], '') AS a, array_to_string(hs[place + 2:], '') AS b FROM p),
      f AS (SELECT doc_id, leaf, changed, subroot, coalesce(string_agg(a || b, '' ORDER BY level) FILTER (level IS NOT NULL), '') AS others, coalesce(list(a || '|' || b ORDER BY level) FILTER (level IS NOT NULL), []) AS steps FROM e GROUP BY doc_id, leaf, changed, subroot, i),
      o AS (SELECT *, list_reduce(steps, lambda h, x: sha256(string_split(x, '|')[1] || h || string_split(x, '|')[2]), changed) AS folded_root FROM f)
      SELECT doc_id, leaf, subroot, root, sha256(others) AS proof_sha256, folded_root, folded_root = root AS verified FROM o, t""",
    "op7_embedding_near_dedup": """WITH RECURSIVE e AS (SELECT vec_id, embedding::double[] AS v FROM embeddings), u AS (SELECT * FROM e WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
      l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a, u b WHERE a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.95e0),
      r AS (SELECT vec_id, vec_id AS id FROM e UNION SELECT r.vec_id, l.b FROM r JOIN l ON l.a = r.id),
      c AS (SELECT vec_id, min(id) AS component_id FROM r GROUP BY vec_id), n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
      SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM e JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)""",
    "op9_substring_dedup": f"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS w FROM documents),
      s AS (SELECT doc_id, unnest(range(1, greatest(len(w) - 11, 1)::bigint)) AS i FROM d), g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM s JOIN d USING (doc_id)),
      m AS (SELECT *, min(doc_id) OVER (PARTITION BY g) AS least FROM g), h AS (SELECT DISTINCT doc_id, i + k AS j FROM m, range(13) AS t(k) WHERE least < doc_id),
      x AS (SELECT doc_id, list(j) AS gone FROM h GROUP BY doc_id), o AS (SELECT doc_id, len(w) AS n, coalesce(len(gone), 0) AS removed, list_filter(w, lambda t, j: gone IS NULL OR NOT list_contains(gone, j)) AS kept FROM d LEFT JOIN x USING (doc_id))
      SELECT doc_id, n AS n_words, removed AS n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM o""",
}
