import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and repeated rows, ties, a long text, and columns with clashing names."""
    long = " ".join(f"w{i % 977}" for i in range(30_000)) + "x" * 100_000
    rows = [
        (None, None, None, None, None), (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, "one two", "en", None, 7),
        (3, "one two", "en", None, 7), (4, "one two three four five six", "de", "b", 27), (5, "one two three four five six", "de", "b", 27),
        (6, long, "fr", "é", len(long)), (None, "mail me: bob@example.com or +1 (523) 555-1055", "en", "b", 46), (-7, "\n\t \x0b", "es", "zz", 5),
        (8, "You are an idiot, pathetic worthless loser and scum", "en", "a", 51), (9, "😀 İ ΑΣ <|endoftext|> don't", "el", "b", 25),
    ]
    extra = ["component_id long", "spans string", "score double", "rank int", "words string", "key string", "size long", "h string", "off long", "target int"]
    return spark.createDataFrame([r + (None,) * len(extra) for r in rows], ", ".join([SCHEMA, *extra]))


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
