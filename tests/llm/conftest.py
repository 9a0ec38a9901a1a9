import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, range string, base string, row long, spans string, key string, words string"
LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns named as the operators' own."""
    texts = [
        (1, LONG), (2, LONG + " end"), (3, LONG), (3, LONG), (4, None), (5, ""), (6, "  \n\t "), (7, "one"), (8, "été naïve ÀÉ ß 漢字 ▁ mark x"),
        (9, "word " * 3000), (10, "x" * 50_000), (11, "<|endoftext|> <s> it's THEY'RE 1234 ½"), (None, "no id here"), (12, "a a a a a a a a a a a a a a a b"), (13, "b a a a a a a a a a a a a a a a"),
    ]
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "r", "b", 1, "s", "k", "w") for i, t in texts], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
