import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from text_samples import prose  # noqa: E402


@pytest.fixture(scope="session")
def messy(spark):
    """Documents with nulls in every column, empty and long texts, repeated rows, and extra columns with clashing names."""
    base = prose(1, 400)
    rows = [
        (1, base, "en", "a", 1),
        (2, base.upper(), "en", "a", 1),
        (3, base + " tail", None, "b", None),
        (4, None, "en", "b", 0),
        (5, "", "en", None, 0),
        (6, "   \n\t ", "fr", "b", 6),
        (7, "One", "fr", "c", 3),
        (8, "one two", "fr", "c", 7),
        (8, "one two", "fr", "c", 7),
        (None, prose(3, 60), "en", None, 5),
        (9, prose(4, 20_000), "en", "c", 9),
        (10, prose(5, 80) + " " + prose(6, 70), "de", "a", 1),
        (11, prose(7, 90) + " " + prose(6, 70), "de", "a", 1),
        (12, "é <|endoftext|> ñ 日本 ½ 🙂 a\x00b", "es", "d", 2),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    extra = {c: df["lang"] for c in ("_id", "_text", "_row", "_h", "size", "score", "_hash", "a", "b", "node", "_toxic", "kept", "target")}
    return df.withColumns(extra)


@pytest.fixture(scope="session")
def empty(messy):
    return messy.limit(0)
