"""Small tables for the tests of this folder."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = [a + b for a in "bdfgklmnprst" for b in "aeiou"]


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choices(SYLLABLES, k=rng.randint(1, 3))) for _ in range(n)]


def documents(spark, texts):
    """Documents from texts or (doc_id, text) pairs, with columns whose names clash with the operators' own."""
    rows = [(t if isinstance(t, tuple) else (i, t)) for i, t in enumerate(texts)]
    frame = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOCS)
    from pyspark.sql import functions as F

    for name in ("node", "score", "tokens", "buckets", "rate", "bucket", "component"):
        frame = frame.withColumn(name, F.lit("clash"))
    return frame


def corpus(seed: int = 3, n: int = 120) -> list[str]:
    """Texts with exact copies, copies with a few changed words, and everything in between."""
    rng = random.Random(seed)
    out: list[str] = []
    for k in range(n):
        if k < 40 or rng.random() < 0.3:
            out.append(" ".join(words(rng, rng.randint(1, 120))))
        else:
            base = rng.choice(out).split(" ")
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
                base[rng.randrange(len(base))] = rng.choice(SYLLABLES)
            out.append(" ".join(base))
    return out
