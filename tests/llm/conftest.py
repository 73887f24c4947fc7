"""Fixtures of the operator tests."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
sys.path.insert(0, str(Path(__file__).parents[1]))

from helpers_llm import DOCUMENT, ODD_TEXTS, SMALL  # noqa: E402


@pytest.fixture
def odd(spark):
    """Null, empty, very long, tied and repeated rows, a null id, and columns named like results."""
    rows = [(i, t, None, "s", None) for i, t in enumerate(ODD_TEXTS)]
    rows += [(6, ODD_TEXTS[6], "en", None, 1), (None, "a b c d e f g h i j k l m n o p", "en", "s", 2), (None, None, None, None, None)]
    frame = spark.createDataFrame(rows, DOCUMENT)
    return frame.selectExpr("*", "1 AS n_words", "'x' AS spans", "2 AS size", "'y' AS ledger", "3 AS doc", "4 AS row", "5 AS component", "6 AS part")


@pytest.fixture
def nothing(spark):
    return spark.createDataFrame([], DOCUMENT)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")
