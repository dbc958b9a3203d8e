"""Small frames with awkward rows."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, id long, path string"


def frame(spark, rows):
    """Documents (doc_id, text) with columns whose names also occur inside the operators."""
    full = [(i, t, "en", "s", None if t is None else len(t), "x", 7, None) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA)


def prose(rng: random.Random, n: int, words: int = 200) -> str:
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def edited(rng: random.Random, text: str, times: int) -> str:
    words = text.split()
    for _ in range(times):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return " ".join(words)
