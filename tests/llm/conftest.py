import pytest


@pytest.fixture
def docs_of(spark):
    """A documents table of the given texts, ids counting from 0, with columns that no operator should trip over."""

    def make(texts, ids=None):
        rows = [(i if ids is None else ids[i], t, "en", "src0", None if t is None else len(t), "clash") for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")

    return make
