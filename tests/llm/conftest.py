import pytest

ODD = [
    (1, "Plain words of a text that goes on for a while, so that rules have something to see in it. It ends here.", "a"),
    (2, None, "a"),
    (3, "", None),
    (4, " \t\n ", "b"),
    (5, "Plain words of a text that goes on for a while, so that rules have something to see in it. It ends here.", "b"),
    (5, "Plain words of a text that goes on for a while, so that rules have something to see in it. It ends here.", "b"),
    (None, "a text without an id", "b"),
    (7, "word " * 30_000, "b"),
    (8, "é" * 20_000, "c"),
    (9, "\x1c ﻿ odd <|endoftext|> spaces here \U0001f600 ΑΣ", None),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and very long texts, repeated rows, and extra columns with clashing names."""
    rows = [(d, t, s, None if t is None else len(t), 5, "x", "y", 1.0) for d, t, s in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, size int, score string, component_id string, target double")


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
