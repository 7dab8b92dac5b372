"""Documents with every awkward case: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import pytest

KINDS = "doc_id long, text string, lang string, source string, n_chars long, hash string, label string, _id string, n string, shingle string"
PASSAGE = "the quick brown fox jumps over the lazy dog while seven bright lanterns swing above the quiet harbour at night"


def rows():
    base = [
        (1, PASSAGE),
        (2, PASSAGE.replace(" ", "\t\n", 1)),
        (3, PASSAGE),
        (3, PASSAGE),
        (4, None),
        (5, ""),
        (6, " \n\t"),
        (7, "word"),
        (8, "word " * 30_000),
        (9, PASSAGE + "\n" + PASSAGE + "\nother words follow here"),
        (None, PASSAGE),
        (None, None),
        (10, "Ünïcödé テスト 🙂 it's <|endoftext|> 12345  double  spaces "),
        (11, "Line one of it\nLine two of it\nLine three of it\nunique a b c"),
        (12, "zzz\nLine one of it\nLine two of it\nLine three of it\nunique d e f"),
    ]
    return [(i, t, None if k % 5 == 0 else "en", None if k % 4 == 0 else "ab"[k % 2], None, "h", "l", "i", "n", "s") for k, (i, t) in enumerate(base)]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(rows(), KINDS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], KINDS)
