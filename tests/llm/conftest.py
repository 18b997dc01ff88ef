import random

import pytest


@pytest.fixture
def rng():
    return random.Random(11)


@pytest.fixture
def vocabulary():
    return [f"w{i}" for i in range(3000)]


@pytest.fixture
def odd_docs(frame):
    """Nulls, empty and long texts, repeated rows, clashing extra columns."""
    rows = [(1, None, "a", 0, "x"), (None, "hello there world again", "b", 1, "y"), (2, "", "c", 2, None), (3, "  \n\t ", None, 3, "z"), (4, "word " * 30_000, "e", 4, "w"), (5, "same text here for two rows", "f", 5, "v"), (5, "same text here for two rows", "f", 5, "v"), (6, "日本語 \x00 \x1c é", "g", None, "u")]
    return frame(rows, "doc_id long, text string, id string, row long, label string")
