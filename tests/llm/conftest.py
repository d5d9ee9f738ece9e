"""Small fixtures for the training-data operators."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

TEXTS = [
    (1, "One two three four five six seven eight nine ten.\nA line of its own\nand more", "en", "b", 70),
    (2, "One two three four five six seven eight nine ten.\nA line of its own\nand more", "en", "a", 70),
    (3, "one two three four five six seven eight nine eleven", "en", "a", 50),
    (4, None, None, None, None),
    (5, "", "de", "a", 0),
    (6, " \t\n ", "de", None, 4),
    (7, "Ärger ÄRGER ärger   x y 語 語", "de", "ß", 20),
    (8, "short", "en", "c", 5),
    (8, "short", "en", "c", 5),
    (None, "no id here", "en", "c", 10),
    (9, "long " * 3000 + "tail", "en", "b", 15004),
    (10, "long " * 3000 + "tails", "en", "b", 15005),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty, blank and long texts, repeated rows, and extra columns with clashing names."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(TEXTS, SCHEMA)
    clashing = ["keep_id", "kept", "size", "target", "component_id", "word", "print", "score", "label", "n_tokens", "_text", "place", "cleared", "_key", "_hash", "_row", "_print", "_id", "_of", "_gone", "copies"]
    return docs.withColumns({c: F.lit("clash") for c in clashing})


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
