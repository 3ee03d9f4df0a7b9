import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, spans string, ids string, title string"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table of texts, with extra columns whose names operators use inside."""

    def make(texts, ids=None):
        rows = [(i, t, "en", "s", None if t is None else len(t), "x", "x", "x", "x") for i, t in zip(ids if ids is not None else range(len(texts)), texts, strict=True)]
        return spark.createDataFrame(rows, DOCS)

    return make


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, one word, very long, repeated."""
    return [None, "", " \n\t ", "word", "long text " * 40_000, "same words here again and again", "same words here again and again"]
