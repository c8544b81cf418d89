import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def sentence(k, n=60):
    return " ".join(WORDS[(k * 7 + i * (k % 5 + 1)) % len(WORDS)] + str((k + i) % 9) for i in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and long texts, repeated rows, ties on the id, equal and near texts."""
    rows = [(k, sentence(k), "en", "s", 1) for k in range(12)]
    rows += [(20, sentence(3), "en", None, None), (21, sentence(4) + " more", None, "s", 2), (22, "", "en", "s", 0),
             (23, None, None, None, None), (24, None, "en", "s", 0), (25, "   \n\t ", "xx", "s", 4), (26, "one", "en", "s", 3),
             (None, sentence(3), "en", "s", 1), (None, None, "en", "s", 1), (27, "Ünï cödé 日本 " * 40, "de", "s", 1),
             (27, "Ünï cödé 日本 " * 40, "de", "s", 1), (28, sentence(5), "en", "s", 1), (28, sentence(6), "en", "s", 1),
             (29, sentence(1, 30000), "en", "s", 1), (30, "\x00\x01 a b　c \x1c d", "en", "s", 1)]
    return rows


CLASH = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    """The odd rows with further columns whose names operators use themselves."""
    extra = ["score", "spans", "kept", "hits", "items", "n_words", "ids", "decoded", "lang_pred", "label", "fp", "slot", "n_bytes"]
    df = spark.createDataFrame(odd_rows, CLASH)
    return df.selectExpr("*", *[f"'x' AS {c}" for c in extra])


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], CLASH)
