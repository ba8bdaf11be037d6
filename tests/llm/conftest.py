import pytest
from llm_helpers import prose

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rejected string, band string, th string, hit string"


@pytest.fixture
def documents(spark):
    """(doc_id, text) pairs -> a table with more columns, whose names clash with internal ones."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "y", "z", None) for i, t in rows], SCHEMA).repartition(3)

    return make


@pytest.fixture
def awkward():
    """Nulls, empties, ties, repeats, one very long text, unusual characters."""
    a = prose(1, 120)
    return [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, a), (6, a), (6, a), (None, a), (None, None), (7, prose(2, 60_000)), (8, "é日😀\x00ß " * 50), (9, "x" * 5000), (10, "one")]
