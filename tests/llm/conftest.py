import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Builds a documents table from (doc_id, text) or whole rows."""
    def make(rows):
        full = [tuple(r) + (("en", f"s{i % 3}", len(r[1] or "")) if len(r) == 2 else ()) for i, r in enumerate(rows)]
        return spark.createDataFrame(full, SCHEMA)
    return make
