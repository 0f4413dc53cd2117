import pytest

WORDS = "thes ofer andre ingth tion erhe atth onan heren ouing stre ndea".split()


def sentence(seed: int, n: int) -> str:
    """Deterministic invented prose."""
    out, x = [], seed * 7919 + 13
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[(x >> 8) % len(WORDS)] + WORDS[(x >> 16) % len(WORDS)])
    return " ".join(out)


@pytest.fixture(scope="session")
def prose():
    return sentence


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, and columns with clashing names."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, fp string, shard string, kept string, _text string, _0 string"
    rows = [
        (1, sentence(1, 80), "en", "a", 10), (2, sentence(1, 80), "en", "a", 10), (2, sentence(1, 80), "en", "a", 10), (3, "", "en", "b", 0), (4, None, None, None, None),
        (None, sentence(2, 60), "en", "b", 5), (5, sentence(3, 20_000), "fr", "b", 9), (6, "12 34 !!", "fr", "b", 8), (7, "\t \n ", "fr", None, 4), (8, sentence(1, 78) + " changed", "en", "a", 3),
        (9, "Ünïcode 日本 the end", "fr", "c", 1), (10, sentence(4, 40) + " " + sentence(1, 30), "fr", "c", 1),
    ]
    return spark.createDataFrame([r + ("x", "y", "z", "k", "t", "0") for r in rows], schema)


@pytest.fixture(scope="session")
def odd_labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 0, 1), (3, None, None), (None, 1, 1), (5, 1, 0), (99, 0, 1)], "doc_id long, quality int, toxic int")
