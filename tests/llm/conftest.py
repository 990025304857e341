import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids int, score int, key int, n int, root int, target int, size int"


def _row(i, text, lang="en", source="src0"):
    return (i, text, lang, source, len(text) if text is not None else None, 7, 7, 7, 7, 7, 7, 7)


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, ties, and clashing extra columns."""
    rnd = random.Random(4)
    words = ["the", "of", "and", "then", "there", "other", "on", "in", "it", "was"]
    long = " ".join(rnd.choice(words) for _ in range(60_000))
    base = "one two three four five six seven eight nine ten eleven twelve"
    rows = [_row(1, None), _row(2, ""), _row(3, " \t\n "), _row(4, long), _row(5, base), _row(6, base), _row(6, base), _row(7, "One Two three"),
            _row(8, "one two THREE", None, None), _row(None, base, None, None), _row(10, "x"), _row(11, "%%% 123 ---"),
            _row(12, "el perro la casa los gatos", "es", "src1"), _row(13, "漢字 é ▁ \x00 😀", "es", "ä"), (None,) * 12]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)
