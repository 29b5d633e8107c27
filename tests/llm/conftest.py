import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture()
def scratch(spark):
    from tidelake.session import Scratch

    return Scratch(spark, "test")


@pytest.fixture(scope="session")
def documents(spark):
    """Few rows with nulls, empty and long texts, copies, near copies, ties and a repeated row."""
    base = [f"w{k % 97}x{k}" for k in range(160)]
    near = [*base[:100], "other", *base[101:]]
    half = [*base[:80], *[f"q{k}" for k in range(80)]]
    long = " ".join(f"t{k * 7919 % 10007}" for k in range(30_000))
    rows = [
        (1, " ".join(base), "en", "a"), (2, " ".join(near), "en", "a"), (3, " ".join(base), "en", "b"), (4, " ".join(half), "en", None), (5, "", "en", "a"),
        (6, None, None, "c"), (7, "one two", "en", "b"), (8, "ONE  two\n", "en", "b"), (9, "one", "fr", ""), (10, long, "en", "c"), (11, "x " + long, "en", "c"),
        (12, "ha " * 900, "en", "d"), (None, "no id here at all", "en", "d"), (14, "É" * 300 + " é", "fr", "d"), (15, " \t\n", "en", "a"), (7, "one two", "en", "b"),
    ]
    data = [(i, t, g, s, None if t is None else len(t), k) for k, (i, t, g, s) in enumerate(rows)]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, n long").repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, n long")
