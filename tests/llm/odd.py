"""Tables with all that may go wrong: nulls, empty and long texts, repeated rows, and
extra columns named like the operators' own."""

from __future__ import annotations

import random

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, id long, content long, "
    "raw string, size int, node string, root string, row int, seed int, bucket int, kept string, "
    "spans string, _id long, _own string, _chance double, _cell long, _hash long, _bytes long"
)
EXTRAS = 17


def prose(rng: random.Random, words: int) -> str:
    stock = ["the", "of", "and", "river", "stone", "under", "walked", "seven", "bright", "night"]
    return " ".join(
        rng.choice(stock) if rng.random() < 0.5 else "".join(rng.choices("abcdefghij", k=6))
        for _ in range(words)
    )


def rows(seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    long_text = prose(rng, 30_000)
    twin = prose(rng, 300)
    near = twin.split()
    near[100] = "changed"
    texts = [
        (1, twin, "en", "a"),
        (2, " ".join(near), "en", "a"),
        (3, twin, "de", "b"),
        (3, twin, "de", "b"),  # a repeated row
        (4, None, None, None),
        (None, None, "en", "a"),
        (5, "", "en", None),
        (6, " \n\t ", "fr", "b"),
        (7, long_text, "en", "c"),
        (8, "two words", None, "c"),
        (None, prose(rng, 120), "en", None),
        (9, "naïve café ☕ résumé " * 30, "fr", "d"),
        (10, "x" * 5_000, "en", "d"),
        (11, "same line here\n" * 80, "en", "e"),
    ]
    texts += [(20 + i, prose(rng, 150), "en", "f") for i in range(20)]
    return [(*t, len(t[1] or ""), *[None] * EXTRAS) for t in texts]


def documents(spark, seed: int = 1):
    return spark.createDataFrame(rows(seed), SCHEMA).repartition(3)


def none(spark):
    return spark.createDataFrame([], SCHEMA)
