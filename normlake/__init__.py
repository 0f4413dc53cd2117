"""Rule-governed text corpora on Spark: retrieval, checks, review and event folds as DataFrame jobs."""
