import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
BASE = "The quick brown fox jumps over the lazy dog while forty two other animals watch from the hill and wonder why it runs so fast today"


def odd_rows():
    """Nulls, empty and very long texts, ties, repeated rows, odd characters."""
    words = BASE.split()
    near = words.copy()
    near[-1] = "tomorrow"
    return [
        (1, BASE, "en", "b", 10),
        (2, BASE, "en", "b", 10),
        (2, BASE, "en", "b", 10),
        (3, BASE.replace(" ", " \n\t "), None, None, None),
        (4, " ".join(near), "en", None, 1),
        (5, None, None, "a", None),
        (6, "", "en", "a", 0),
        (7, " \n ", "de", "a", 3),
        (None, "no id at all, still a document", "en", "c", 1),
        (None, "no id at all, still a document", "en", "c", 1),
        (8, "123 !!! 456", "en", "c", 3),
        (9, "der die das und nicht mit Übergröße", "de", "c", 3),
        (10, "x" * 70_000, "en", "ä", 70_000),
        (11, "eins zwei drei " * 9_000, "de", "ä", 1),
        (11, "another text with the same id", "en", "ä", 1),
        (12, "\x00\x1c   astral 😀 text <|endoftext|> it's don't 日本語、テスト。", "xx", "Z", 5),
        (13, "All Rights Reserved. Licensed under CC BY-NC 4.0; GNU General Public License, version 3", "en", "Z", 5),
    ]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="session")
def clashing(odd):
    """The same with columns named like the operators' own."""
    from pyspark.sql import functions as F

    names = "size target copies taken source_size keep_id kept group_size text_sha256 lang_pred score pii spans n_tokens n_bytes batch bucket length id v text_hash class_id n_words labels items digest".split()
    return odd.select("*", *(F.lit("own").alias(n) for n in names))


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
