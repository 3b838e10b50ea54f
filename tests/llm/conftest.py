import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from brute import prose  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SMALL


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, and extra columns with names that operators use."""
    base = prose(1, 200)
    rows = [(0, None), (1, ""), (2, " \n\t\r\n "), (3, prose(2, 60_000)), (4, "one two three"), (5, base), (6, base),
            (7, base.replace(" ", " zz ", 3)), (8, "one two three"), (9, "x" * 50_000), (10, "Café ßäñ 日本 " * 30),
            (11, prose(3, 100) + "\n" + base), (12, "a\n\na\nb\n")]
    out = [(d, t, "en", f"src{d % 3}", None if t is None else len(t), d, 1, "k", 0.5) for d, t in rows]
    return spark.createDataFrame(out, "doc_id long, text string, lang string, source string, n_chars long, id long, n int, `key` string, row double"), rows


@pytest.fixture(scope="session")
def null_ids(spark):
    base = prose(1, 200)
    return spark.createDataFrame([(None, base), (3, base), (None, None), (3, base), (4, prose(9, 50)), (None, prose(9, 50))],
                                 "doc_id long, text string")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
