import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """Rows (doc_id, text) as a documents table, with further columns whose names clash with inner ones."""

    def make(rows):
        full = [(i, t, "en", "s", None if t is None else len(t), "x", "y", "z") for i, t in rows]
        return spark.createDataFrame(
            full,
            "doc_id long, text string, lang string, source string, n_chars long, words string, key string, row string",
        )

    return make


#: Texts every operator must stand: missing, empty, blank, one word, very long, repeated, without letters.
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, "many words here " * 8000), (6, "same text twice over"),
    (7, "same text twice over"), (7, "same text twice over"), (None, "no id at all"), (None, None), (8, "1234 5678 !!"),
]


@pytest.fixture(scope="session")
def odd(docs_of):
    return docs_of(ODD)
