"""The pipeline's stages on odd rows and as a whole."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from normlake.llm import staging

from .conftest import sentence


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    docs = [(i, sentence(i, 60) if i % 3 else "$$$ ".join(sentence(i, 60).split()), "en", "s", 1) for i in range(90)] + [(1000, sentence(1, 60), "en", "s", 1), (1001, sentence(1, 30) + " " + sentence(2000, 30), "en", "s", 1), (None, None, None, None, None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(90)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_keep_clean_documents(spark, folder):
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        columns, docs = docs.columns, staging.stage(stage(spark, docs, folder))
        seen[name] = docs
        if name != "best-fit packing":
            assert docs.columns == columns
    ids = {n: {r["doc_id"] for r in d.select("doc_id").collect()} for n, d in seen.items()}
    clean = {i for i in range(90) if i % 3}
    assert clean <= ids["quality classifier"] and not {i for i in range(90) if i % 3 == 0} & ids["quality classifier"]
    assert 1000 not in ids["SimHash near-dedup"] and 1 in ids["SimHash near-dedup"]
    cut = {r["doc_id"]: r["text"] for r in seen["substring dedup"].collect()}
    assert cut[1001] == sentence(2000, 30) and cut[1] == sentence(1, 60)
    assert corpus_pipeline.run(spark, folder).select("doc_id").distinct().count() == len(ids["best-fit packing"])


def test_stages_on_odd_and_empty_tables(spark, folder, odd_docs):
    for table in (odd_docs, odd_docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            found = stage(spark, table, folder)
            if name != "best-fit packing":
                assert found.columns == table.columns and found.count() <= table.count()
            else:
                assert found.agg(F.count_distinct("doc_id")).first()[0] == table.agg(F.count_distinct("doc_id")).first()[0]


def test_documents_without_id_stay_once(spark):
    rows = [(None, sentence(1, 60)), (None, sentence(1, 60)), (None, sentence(2, 60)), (7, sentence(2, 60)), (8, sentence(3, 60))]
    found = corpus_pipeline.near_duplicate_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in found) == sorted([(0, sentence(1, 60)), (7, sentence(2, 60)), (8, sentence(3, 60))])


def test_a_text_goes_to_python_once(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for stage, more in ((corpus_pipeline.quality_stage, 0), (corpus_pipeline.language_stage, 0), (corpus_pipeline.repeats_stage, 1)):
        plan = stage(spark, docs, folder)._jdf.queryExecution().optimizedPlan()
        while plan.nodeName() != "MapInArrow":
            plan = plan.children().head()
        assert plan.children().head().output().size() == len(docs.columns) + more


def test_repeats_far_apart_in_one_batch_are_cut(spark):
    rows = [(i, sentence(i, 20) + (f" {sentence(99_999, 15)}" if i in (10, 1400) else ""), 1) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").coalesce(1)
    found = {r["doc_id"]: r["text"] for r in corpus_pipeline.repeats_stage(spark, docs, "").collect()}
    assert len(found) == 1500 and found[1400] == sentence(1400, 20) and found[10] == rows[10][1]
