import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def table(spark):
    """A documents table of (id, text) pairs, with a column whose name clashes with the operators' own."""

    def make(rows, lang=None):
        full = [(i, t, lang and lang(i), "s", len(t or "")) for i, t in rows]
        df = spark.createDataFrame(full, DOCS)
        return df.selectExpr("*", "'x' AS shard", "'y' AS print", "'z' AS words", "1 AS n_words")

    return make
