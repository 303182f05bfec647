"""Small inputs with the awkward cases every operator must take."""

from __future__ import annotations

import random

CLASHING = "key string, code string, digest string, kept_id long, own string, language string, bin long, runs string, spans string, first_id long"
CLASH = ("k", "c", "d", 1, "o", "l", 2, "r", "s", 3)
SCHEMA = "doc_id long, text string, lang string, source string, " + CLASHING


def sentence(rng: random.Random, words: int, vocabulary: str = "alpha beta gamma delta omega sigma kappa theta lorem ipsum dolor amet") -> str:
    return " ".join(rng.choice(vocabulary.split()) for _ in range(words))


def rows() -> list[tuple]:
    rng = random.Random(5)
    long = sentence(rng, 3000, " ".join(f"w{i}" for i in range(900)))
    base = sentence(rng, 120)
    out = [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, " \t\n ", None, "a"), (4, "one", "en", None), (5, "1234 !!", "en", "a"),
        (6, long, "en", "a"), (7, long + " end", "fr", "b"), (8, base, "en", "a"), (9, base, "en", "a"), (9, base, "en", "a"),
        (None, "a text without an id", "en", "b"), (None, None, None, None), (10, base.replace(" ", "  "), "en", "a"), (11, "ab" * 400, "en", "b"), (12, "é\U0001f600 " * 90, "fr", "b"),
    ]
    out += [(20 + i, sentence(rng, rng.randint(1, 80)), "en", f"s{i % 3}") for i in range(25)]
    return out


def docs(spark, of: list[tuple] | None = None):
    return spark.createDataFrame([r + CLASH for r in (rows() if of is None else of)], SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
