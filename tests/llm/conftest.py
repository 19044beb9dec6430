from __future__ import annotations

import pytest
from pyspark.sql import DataFrame

# Texts every operator has to stand: null, empty, blank, odd characters, very long words and texts.
ODD_TEXTS = [None, "", " ", "\n\n", "\t", "a", "A a", "123 !!", "été 漢字 \U0001f600", "x" * 5000, "word " * 9000,
             "one two\n" * 3, " nbsp line\x1csep", "the same text", "the same text"]


@pytest.fixture(scope="session")
def odd_docs(spark) -> DataFrame:
    """Odd texts, a null id, repeated rows, and columns whose names clash with those the operators make."""
    rows = [(i, t, "en", "s", len(t or ""), 1, 2, "c", "d") for i, t in enumerate(ODD_TEXTS)]
    rows += [(None, "no id here", None, None, None, 1, 2, "c", "d"), rows[-1], rows[-1]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_tokens int, "
                                       "fp int, key string, shard string")


@pytest.fixture(scope="session")
def no_docs(spark, odd_docs) -> DataFrame:
    return odd_docs.where("false")
