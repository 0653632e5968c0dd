import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """A documents table from texts; doc_id is the place, or given as (doc_id, text[, lang, source])."""

    def make(rows):
        full = []
        for k, row in enumerate(rows):
            row = row if isinstance(row, tuple) else (k, row)
            row = (*row, "en", "src0")[:4] if len(row) == 2 else (*row, "src0")[:4]
            full.append((*row, len(row[1] or "")))
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture(scope="session")
def sample():
    """Texts of the smallest table, odd cases first."""
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"]).column(0).to_pylist()
    odd = [None, "", " ", "a", "  two  spaces ", "tab\tand\nfeed\n\nend\n", "é ü 漢字 😀 ▁x", " nbsp  ", "a" * 5000, "x y " * 3000]
    return odd + texts + texts[:10]
