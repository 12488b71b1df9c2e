import pytest

LONG = ("lorem ipsum dolor " * 9000).strip()

TEXTS = [
    "The quick brown fox jumps over the lazy dog and then it sleeps.",
    "The quick brown fox jumps over the lazy dog and then it sleeps.",
    "The  quick\nbrown fox jumps over the lazy dog and then it sleeps.",
    "",
    None,
    "   ",
    "Der schnelle braune Fuchs springt über den faulen Hund, und dann schläft er.",
    "El zorro marrón salta sobre el perro perezoso y luego duerme.",
    LONG,
    "one",
    "one two",
    "1234",
    "Mail bob.smith@mail.example.com or call +1 (415) 555-2671 from 10.0.0.1 now.",
]


@pytest.fixture(scope="session")
def docs(spark):
    """Texts with nulls, copies, a very long one, a repeated row, and columns whose names clash with inner ones."""
    rows = [(i, t, ("en", "de", None)[i % 3], (None, "b", "a", "b")[i % 4], 0, b"x", "y", 1) for i, t in enumerate(TEXTS)]
    rows.append(rows[0])
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, digest binary, size string, fp long")


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
