import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Documents from texts; rows of another length are given whole."""

    def make(*rows):
        full = [r if isinstance(r, tuple) else (i, r, "en", "s", len(r) if r else None) for i, r in enumerate(rows)]
        return spark.createDataFrame(full, DOCS)

    return make
