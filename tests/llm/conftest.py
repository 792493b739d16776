import pytest

ODD = [
    (1, "The MIT License applies. user: bob42 password = short12", "en", 1),
    (2, None, None, 2),
    (3, "", "en", 3),
    (4, "$$$ 123 !!", "fr", 4),
    (1, "The MIT License applies. user: bob42 password = short12", "en", 1),
    (None, "É été où l’apache  License\nest là 漢字 'token': 'abcdefghijkl0123'", "fr", 5),
    (6, "word " * 30_000, "en", 6),
    (7, "one", None, 7),
    (8, "a b c d e f g h i j k l m n o p", "en", 8),
    (9, "a b c d e f g h i j k l m n o p", "en", 8),
]
EXTRA = ["row", "row_id", "fp", "node", "text_hash", "kind", "group", "mark", "key_a", "lang_pred", "runs", "start"]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns whose names may clash."""
    rows = [(i, t, lang, "s", len(t or ""), *[n] * len(EXTRA)) for i, t, lang, n in ODD]
    extra = ", ".join(f"`{c}` int" for c in EXTRA)
    return spark.createDataFrame(rows, f"doc_id bigint, text string, lang string, source string, n_chars bigint, {extra}")


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def small_rows(small):
    return [(r.doc_id, r.text) for r in small.select("doc_id", "text").collect()]
