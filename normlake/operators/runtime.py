"""Runtime retrieval: what an active bundle has to say about an edit, directly applicable rules before ranked ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.shared import stored
from ..functions.sizes import is_small
from . import ranking
from . import retrieval as r
from .bundles import Bundle
from .checks import applicable


def runtime_rules(bundle: Bundle, queries: DataFrame, limit: int = 20, scopes: list[str] | str | None = None, categories: list[str] | str | None = None, stop: list[str] | None = None, weight: float = 0.4, least: float = 0.28, probes: int = 8) -> DataFrame:
    """``query_id, rule_id, direct, score, checkers, place, hits`` and the card's columns for a stated set of queries (``query_id, query, path, code``, maybe a vector ``q``).

    Rules that a path or content check applies to (the query counts as content) all come, in order of applicability, however many; ranked rules, by BM25 with
    bonuses and, where there are vectors, similarity, fill up to ``limit``. A direct rule that is also ranked carries its score, one that isn't has none. Scopes and categories are wanted values, case
    apart; statistics always cover the whole bundle. Only the index's buckets of the queries' tokens and the cells nearest to their vectors are read. Nothing comes for a limit of 0.
    """
    texts = queries.select("query_id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("query", "path", "code")])
    terms = r.query_terms(texts, {"query": "query", "path": "path", "code": "code"}, stop)
    rules = bundle.rules
    about = rules.select(F.col("rule_id").alias("doc_id"), F.col("rule_id").alias("id"), "original_id", "severity", F.coalesce("triggers", F.array().cast("array<string>")).alias("triggers"), "scope", "category")
    wanted = stored(r.in_scope(r.in_scope(about, "scope", scopes), "category", categories), "wanted")  # parsed from the records once
    similar = None
    if "q" in queries.columns:
        asked = queries.where("q is not null").select("query_id", "q")
        similar = r.semantic(bundle.vectors(asked, probes), asked, least)
    found = ranking.search_bundle(bundle.index, wanted, texts, terms, max(1, limit), similar, weight)
    few = F.broadcast(found) if is_small(found) else found
    chosen = wanted.select("doc_id", "severity", "triggers").join(few, "doc_id")
    ranked = r.with_hits(r.top_k(chosen, limit, ties=[r.severity_rank(F.col("severity")), "doc_id"]), texts)
    ranked = ranked.withColumn("hits", F.when(F.col("held"), F.col("hits")))
    ranked = ranked.select("query_id", F.col("doc_id").alias("rule_id"), "score", F.col("rank").alias("_ranked"), "hits")
    files = texts.select("query_id", "path", F.concat_ws("\n", "query", "code").alias("content"))
    direct = applicable(files, bundle.checks, keep=["query_id"]).select("query_id", "rule_id", "checkers", F.col("rank").alias("_direct"))
    direct = direct.join(wanted.select(F.col("doc_id").alias("rule_id")), "rule_id", "left_semi")
    both = direct.join(ranked, ["query_id", "rule_id"], "full").withColumn("direct", F.col("_direct").isNotNull())
    order = Window.partitionBy("query_id").orderBy(F.desc("direct"), "_direct", "_ranked")
    placed = both.withColumn("place", F.row_number().over(order).cast("long")).where((F.lit(limit) > 0) & (F.col("direct") | (F.col("place") <= limit)))
    cards = rules.select("rule_id", "title", "statement", "severity", "category", "document", "section")
    labels = F.coalesce("checkers", F.array().cast("array<string>"))
    return placed.select("query_id", "rule_id", "direct", "score", labels.alias("checkers"), "place", F.coalesce("hits", F.array().cast("array<string>")).alias("hits")).join(cards, "rule_id")
