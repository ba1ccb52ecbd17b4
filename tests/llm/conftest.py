from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use for columns of their own.
CLASHES = ("text_key", "fp", "size", "copies", "words", "start", "end", "cuts", "n", "key", "digest", "target", "c0", "nth",
           "doc", "failed", "n_words", "shard", "chunk", "bucket", "keys", "score", "root", "count", "offset", "tier")


def prose(rng: random.Random, n: int, letters: str = "abcdefghijklmnop") -> str:
    words = ["".join(rng.choices(letters, k=rng.randint(2, 7))) for _ in range(n)]
    return "".join(w + ("\n" if rng.random() < 0.08 else " ") for w in words).strip()


def corpus(seed: int = 7, n: int = 120) -> list[tuple]:
    """Documents with copies, near copies, shared passages, nulls, empty and long texts, ties and repeated rows."""
    rng = random.Random(seed)
    rows = []
    passage = prose(rng, 70).replace("\n", " ")
    for i in range(n):
        text = prose(rng, rng.randint(1, 200))
        if i % 9 == 4 and rows:
            text = rng.choice(rows)[1]
        if i % 9 == 5:
            words = (rows[-1][1] or "a b").split(" ")
            words[len(words) // 2] = "changed"
            text = " ".join(words)
        if i % 10 == 3:
            text = f"{text}\n{passage}\n{prose(rng, 5)}"
        rows.append((i, text, ("en", "fr", None)[i % 3], (None, "a", "b", "ñ", "z")[min(i % 9, 4)], len(text)))
    rows += [
        (n, None, "en", "a", None), (n + 1, "", None, None, 0), (n + 2, " \n\t ", "en", "b", 4),
        (n + 3, prose(rng, 30_000), "en", "a", 0), (None, "no id here at all", "en", "a", 17), (None, None, None, None, None),
        (n + 4, "Élan \U0001f600 ça là İstanbul don't 12½", "fr", "ñ", 10), (n + 5, "word " * 200, "en", "z", 1000),
        rows[10], rows[10], rows[11],
    ]
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The corpus with extra columns whose names clash with the operators' own."""
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return frame.withColumns({name: F.lit(f"own {name}") for name in CLASHES}).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
