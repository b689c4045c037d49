import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Makes a documents table with columns that clash with names the operators could use."""

    def make(rows):
        rows = [(i, t, "en", s, None if t is None else len(t), "x", 1) for i, t, s in rows]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, n long")

    return make
