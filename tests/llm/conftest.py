import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from awkward_documents import prose  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use inside.
CLASHING = ["fp", "root", "component_id", "score", "predicted", "text_hash", "spans", "kept", "n_words", "n_removed", "doc", "row", "anchor", "ids", "n_tokens"]


@pytest.fixture(scope="session")
def awkward(spark):
    """Documents with nulls in every column, empty and very long texts, ties,
    repeated rows and names that clash."""
    from pyspark.sql import functions as F
    long = prose(1, 30_000)
    rows = [(1, long, "en", "a", 5), (2, long + " end", "en", "a", 5), (3, "", "en", "a", 0), (4, None, None, None, None), (None, "who is this", "en", "b", 3),
            (None, None, None, None, None), (5, "same words here again", "en", "a", 1), (5, "same words here again", "en", "a", 1), (6, "same words here again", "en", "b", 1),
            (7, "  \t\n ", "en", "a", 2), (8, "you are an idiot! you worthless idiot.", "en", "a", 2), (9, "mail me at joe@example.com or +1 (988) 555-2485.", "en", "a", 2),
            (5, "another text with the same id", "en", "a", 2), (10, "x" * 5000, "de", "c", 2), (11, "é 日本 😀 ﬀ \u200b", "es", "c", 2)]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({c: F.lit("clash") for c in CLASHING}).persist()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
