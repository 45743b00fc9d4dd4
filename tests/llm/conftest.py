from __future__ import annotations

import random

import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long, size long, _key long, fp string, votes string"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (id, text) or (id, text, lang, source), with extra columns whose names clash with those inside the operators."""

    def build(rows):
        full = [(*r, *(None,) * (4 - len(r)), -1, 7, 8, "x", "y") for r in rows]
        return spark.createDataFrame(full, DOC)

    return build


@pytest.fixture(scope="session")
def prose():
    """Random words, some repeated: deterministic."""

    def build(n, seed, words=400):
        rng = random.Random(seed)
        vocabulary = ["".join(rng.choices("abcdefghijklmnoprstuvw", k=rng.randint(2, 9))) for _ in range(words)]
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    return build


EDGE = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (6, None), (7, "word " * 30_000), (8, "ünïcødé 日本 😀 x y"), (None, "no id here"), (9, "a\0b <|endoftext|> c")]


@pytest.fixture(scope="session")
def edge():
    return EDGE
