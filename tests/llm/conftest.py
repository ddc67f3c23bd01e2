import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """A table of documents from (doc_id, text) pairs, with columns whose names clash with the operators' own."""

    def make(rows):
        schema = "doc_id long, text string, lang string, source string, n_chars long, fp long, n_words string, places string, carried int, ids string, kept boolean"
        return spark.createDataFrame([(i, t, "en", "src0", None if t is None else len(t), 1, "x", "y", 2, "z", True) for i, t in rows], schema)

    return make
