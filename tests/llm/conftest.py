import pytest

TABLE = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """DataFrame of documents from (doc_id, text) or (doc_id, text, source) rows, with columns that clash with results."""
    def make(*rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), 0.0, "x") for r in rows]
        return spark.createDataFrame(full, TABLE + ", score double, found string")

    return make
