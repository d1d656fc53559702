import pytest

LONG = "very long text with token = \"0123456789abcdef0123456789abcdef\" inside " * 4_000


#: Names that an operator might want for columns of its own.
CLASHING = ("__digest", "__key", "__copies", "__n", "__language", "__part", "__id", "__mix", "__place", "__cell", "__start", "__local",
            "part", "place", "number", "list0", "bits", "mix", "from", "a.b")


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows and clashing column names."""
    rows = [
        (1, "The quick brown fox jumps over the lazy dog", "en", "a", "x", 1, 1),
        (2, " The quick brown\tfox jumps over the lazy dog", "en", None, "x", 1, 1),
        (3, None, None, "a", None, None, None),
        (4, "", "en", "b", "x", 2, 2),
        (5, " \t\n\x0b\x0c\r ", "en", "b", "x", 2, 2),
        (6, "word", None, "", "x", 3, 3),
        (7, LONG, "en", "a", "x", 4, 4),
        (8, "Der schnelle braune Fuchs springt über den faulen Hund", "de", "b", "x", 5, 5),
        (8, "Der schnelle braune Fuchs springt über den faulen Hund", "de", "b", "x", 5, 5),
        (9, "123 456 !!", "de", "Ä", "x", 6, 6),
        (None, "a row without an id has words too", "en", "a", "x", 7, 7),
        (10, "<|endoftext|> 漢字 \U0001f600 e\u0301", "de", "a", "x", 8, 8),
    ]
    return spark.createDataFrame(
        rows, "doc_id bigint, text string, lang string, source string, id string, size int, label int").selectExpr(
        "*", "1 AS n_chars", "'k' AS key", "'r' AS row", "0 AS rank", "'d' AS digest", "true AS kept", "5 AS shard", "9L AS slot",
        "'n' AS node", "'h' AS host", "1 AS piece", "2 AS target", "3 AS copies", "4 AS score", "'l' AS language",
        *[f"concat('{name}', coalesce(doc_id, 0)) AS `{name}`" for name in CLASHING])


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.where("false")
