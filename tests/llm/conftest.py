"""Small frames for the corpus operators: awkward rows and columns that clash."""

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, key bigint, id string, removed string, key_ string"


def frame(spark, texts, ids=None, langs=None, sources=None):
    rows = [((ids[i] if ids else i), t, (langs[i] if langs else "en"), (sources[i] if sources else f"s{i % 3}"), 0 if t is None else len(t), 1, "x", "y", "z") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture
def odd(spark):
    """Nulls, empties, blanks, ties, repeats and a long text, with clashing column names."""
    long = "all work and no play makes a dull day " * 3000
    texts = [None, "", " \n\t ", "one", "one", "a b c", "a b c", long, "Ünïcode ßtraße wörter\n\nwörter", None, "same words here", "same words here"]
    ids = [1, 2, 3, 4, 5, 6, 6, 7, None, None, 8, 8]
    return frame(spark, texts, ids, [None, "en", "en", "en", "de", "en", "en", "en", "de", None, "en", "en"], [None, "a", "a", "a", "b", "b", "b", None, "c", "c", "a", "a"])
