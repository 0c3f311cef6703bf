"""Small tables with what real ones hold: nulls, empty and long texts, ties, repeats, clashing names."""

import random

import pytest

EXTRA = "words string, row string, id long, whole string, path string, samples string, kept string, text_a string, doc long, uid long"


@pytest.fixture(scope="session")
def words():
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz"
    return ["".join(rng.choices(letters, k=rng.randint(2, 9))) for _ in range(800)]


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) pairs, with further columns whose names clash with inner ones."""

    def documents(pairs, source="web"):
        rows = [(i, t, "en", source, None if t is None else len(t), *[None] * 10) for i, t in pairs]
        return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}")

    return documents


@pytest.fixture(scope="session")
def odd_texts():
    return [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "ünï çödé 漢字 😀 x"), (6, "same words here " * 30), (7, "same words here " * 30), (None, "no id at all"), (9, "q" * 60_000), (10, "<|endoftext|> a  b\r\n c"), (10, "repeated id")]
