"""Small tables with every awkward case, and documents with planted repeats."""

from __future__ import annotations

import random

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, key int, kind string, note binary, node long, label string"


def rows(pairs):
    """Documents with extra columns whose names the operators use themselves."""
    return [(i, t, "en", "s", None if t is None else len(t), 1, "x", None, 5, "y") for i, t in pairs]


def corpus(seed: int, n: int = 60) -> list[tuple[int | None, str | None]]:
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéßñ漢") for _ in range(rng.randrange(1, 7))) for _ in range(400)]
    word = lambda: rng.choice(vocabulary).capitalize() if rng.random() < 0.1 else rng.choice(vocabulary)
    line = lambda k: " ".join(word() for _ in range(k))
    passages = [line(rng.randrange(15, 45)) for _ in range(8)]
    out: list[tuple[int | None, str | None]] = []
    for i in range(n):
        parts = [line(rng.randrange(1, 60)) for _ in range(rng.randrange(1, 4))]
        if rng.random() < 0.5:
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(passages))
        text = rng.choice(["\n", " ", "  ", "\t"]).join(parts)
        if out and rng.random() < 0.25:
            text = rng.choice([t for _, t in out if t])
            if rng.random() < 0.6:
                words = text.split(" ")
                words[rng.randrange(len(words))] = "changed"
                text = " ".join(words)
        out.append((i * 3 % 97, text))
    out += [(1000, None), (1001, ""), (1002, " \n\t "), (1003, "one"), (1004, "two words"), (1005, "ab " * 3000), (1006, "x" * 5000), (1007, "漢字" * 900)]
    return out


@pytest.fixture(scope="session")
def make(spark):
    def frame(pairs):
        return spark.createDataFrame(rows(pairs), DOCUMENTS).repartition(3)
    return frame


@pytest.fixture(scope="session")
def labels_of(spark):
    def frame(pairs):
        return spark.createDataFrame([(i, q, 0) for i, q in pairs], "doc_id long, quality long, toxic long")
    return frame
