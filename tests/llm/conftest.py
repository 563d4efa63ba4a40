import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import pytest  # noqa: E402

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Makes a documents table from (doc_id, text) pairs, with columns named like those of the operators."""

    def make(rows, extra=False):
        table = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOC)
        if extra:
            for name in ("words", "row", "lines", "token", "gone", "n_removed", "hit_id", "text_key", "label_id", "piece", "n", "part"):
                table = table.withColumn(name, table.doc_id)
        return table

    return make


@pytest.fixture(scope="session")
def words():
    """Distinct invented words: deterministic, one per number."""
    letters = "abcdefghijklmnopqrstuvwxyz"

    def word(n):
        out = ""
        for _ in range(5):
            n, r = divmod(n * 7919 + 13, 26)
            out += letters[r]
        return out + letters[n % 26]

    return lambda start, count: [f"{word(i)}{i}" for i in range(start, start + count)]
