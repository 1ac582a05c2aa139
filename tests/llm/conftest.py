import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size bigint, kept boolean, n bigint, score string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls everywhere, empty, blank and very long texts, ties, repeated rows, clashing extra columns."""
    long = " ".join(f"w{i % 977} the" for i in range(60_000))
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
    texts = [
        (1, base, "en", "a"), (2, base, "en", "a"), (2, base, "en", "a"), (3, base + " seventeen", "en", None),
        (4, None, None, None), (5, "", "en", "b"), (6, " \n\t", "fr", "b"), (7, long, "de", "b"), (8, "<|endoftext|> Ünïcode İ ΑΣ don't 12!! ###", "de", "c"),
        (9, "hi", "en", "c"), (10, "Hi", "en", "c"), (None, "null id here and some more words", "en", "c"), (None, "null id here and some more words", "en", "c"),
    ]
    return spark.createDataFrame([(i, t, lang, s, None, 7, True, 3, "x") for i, t, lang, s in texts], SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
