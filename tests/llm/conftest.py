import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs_of(spark):
    """A documents table from (doc_id, text) pairs or full rows."""
    def make(rows):
        full = [(*r, None, None, len(r[1] or ""))[:5] if len(r) == 2 else r for r in rows]
        return spark.createDataFrame(full, DOCS)
    return make
