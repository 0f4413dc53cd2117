"""The corpus pipeline: quality, language, near-duplicates, repeated passages, packing.

Each stage takes ``(spark, docs, sf_dir)``, works on all rows that its predecessor kept and returns
a DataFrame, which is written as Parquet and read again as the next stage's ``docs``. All but the
last return the columns of ``docs``; further columns, whatever their names, pass through unread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from normlake.llm import jaccard, language, packing, quality, staging, substring
from normlake.llm.queries import tokenizer_path

LEAST_QUALITY = 0.5
LEAST_LANGUAGE = 0.5


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the quality classifier gives a score of ``LEAST_QUALITY`` or more.

    Null and empty texts are scored by the model's bias, repeated rows each time, so ties stay or go together; without labelled rows of both classes every
    score is 0.5 and all rows stay. An empty table gives no rows.
    """
    params = quality.QualityParams()
    sample = quality.labelled_sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "quality", 3, 1, params.rows_per_class, params.max_chars)
    return _judged(docs, lambda rows, text: quality.score(rows, sample, params, text, keep=rows.columns), "score", F.col("score") >= LEAST_QUALITY)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents of a known language; those without letters, null texts included, or whose languages tie with others go.

    If no row has a language to learn from, all rows go. Repeated rows are judged each time; an empty table gives no rows.
    """
    params = language.LanguageParams()
    sample = language.learn_sample(docs, 3, 1, params)
    sure = (F.col("lang_pred") != language.UNDETERMINED) & (F.col("score") >= LEAST_LANGUAGE)
    return _judged(docs, lambda rows, text: language.identify(rows, sample, params, text, keep=rows.columns), "lang_pred", sure)


def _judged(docs: DataFrame, judge, first_new: str, verdict) -> DataFrame:
    """The rows of ``docs`` that pass; its columns are numbered meanwhile, so that none clashes."""
    names = docs.columns
    numbered = docs.toDF(*[f"_{i}" for i in range(len(names))])
    return judge(numbered, f"_{names.index('text')}").where(verdict).select(*[F.col(f"_{i}").alias(n) for i, n in enumerate(names)])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the least id of each group of near-duplicates (five words, Jaccard similarity of 0.8 or more).

    Operator 2's SimHash trees give some of the links; what they miss at this similarity comes from ``jaccard``'s minima, and every link is judged by the
    whole sets. Rows that share an id are one document and stay or go together. Of a group without any id one row stays, the alphabetically first text of
    the least set of shingles. Null and empty texts are one group, as texts without words; an empty table gives no rows.
    """
    found = staging.stage(jaccard.near_duplicates(docs, width=5))
    groups = found.groupBy("root").agg(F.min("doc_id").alias("_id"), F.min("set_id").alias("_set_id"))
    stay = groups.where("_id IS NOT NULL").select("_id").distinct()
    known = docs.join(stay, docs["doc_id"] == stay["_id"], "left_semi")
    names = docs.columns
    nameless = docs.where(F.col("doc_id").isNull()).toDF(*[f"_{i}" for i in range(len(names))])
    nameless = jaccard.with_set_id(nameless, 5, f"_{names.index('text')}").join(groups.where("_id IS NULL").select("_set_id"), "_set_id", "left_semi")
    row = F.struct(*[F.col(f"_{i}").alias(n) for i, n in enumerate(names)])
    least = nameless.groupBy("_set_id").agg(F.min_by(row, F.coalesce(f"_{names.index('text')}", F.lit(""))).alias("_row"))
    return known.unionByName(least.select(*[F.col("_row")[n].alias(n) for n in names]))


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of 13 words or more that a document with a smaller id holds too.

    A document that loses words becomes its remaining words with one space between two (and its
    ``n_chars`` follows); one that loses all of them goes, and one that loses none stays as it is.
    """
    names = docs.columns
    numbered = docs.toDF(*[f"_{i}" for i in range(len(names))])
    text = f"_{names.index('text')}"
    found = substring.remove_repeats(numbered, text=text, doc_id=f"_{names.index('doc_id')}", keep=numbered.columns)
    cut = F.col("n_removed") > 0
    new = {"text": F.when(cut, F.col("kept")).otherwise(F.col(text))}
    if "n_chars" in names:
        n_chars = f"_{names.index('n_chars')}"
        new["n_chars"] = F.when(cut, F.length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col(n_chars))
    return found.where(~cut | (F.col("kept") != "")).select(*[new.get(n, F.col(f"_{i}")).alias(n) for i, n in enumerate(names)])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 2048 tokens; one row for each piece.

    A null or empty text is one piece that holds the end mark; repeated rows are packed each time; an empty table gives no rows.
    """
    return packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality_stage),
    ("language ID", language_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("substring dedup", repeats_stage),
    ("best-fit packing", packing_stage),
]

#: Learned models, components and packing aren't expressible in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; what each returns is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = staging.stage(stage(spark, docs, sf_dir))
    return docs
