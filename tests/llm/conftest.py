import pytest


@pytest.fixture(scope="session")
def shared(spark):
    return spark


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(shared):
    """Rows of texts (or of (id, text)) as documents, with columns whose names clash with those of the operators."""

    def make(*texts):
        rows = [(t if isinstance(t, tuple) else (i, t)) for i, t in enumerate(texts)]
        return shared.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOCUMENTS)

    return make
