"""Training-data operators: quality, near-duplicates, tokens, toxicity, packing, sharding, language.

Each module holds one operator with its own general interface; ``queries`` binds them to the
``documents``/``embeddings`` tables. Nothing outside this package imports it.
"""
