import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from texts (ids from 0), with columns whose names may clash."""

    def make(texts, ids=None):
        ids = list(range(len(texts))) if ids is None else ids
        rows = [(i, t, "en", "s", len(t or ""), "x") for i, t in zip(ids, texts)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string")

    return make
