"""Small document tables with the cases that every operator must take."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, key long, shard string"

WORDS = "the quick brown fox jumps over a lazy dog while seven wizards pack my box with liquor jugs été über straße niño".split()


def texts(seed: int = 1, n: int = 30) -> list[str]:
    rng = random.Random(seed)
    base = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 90))) for _ in range(n)]
    near = []
    for t in base[:8]:
        w = t.split()
        w[rng.randrange(len(w))] = rng.choice(WORDS)
        near.append(" ".join(w))
    return base + near + base[:5]


def rows(seed: int = 1) -> list[tuple]:
    """Nulls, empty and blank texts, a very long one, ties, repeated rows, further columns with clashing names."""
    odd = [None, "", "  ", "\n", "word", "a  b", "x" * 300, "Tab\tand\x0bnewline\n", "emoji 😀 中文 naïve", ("long " * 4000).strip(), "a b c", "é" * 120]
    found = [(10 * i, t) for i, t in enumerate(texts(seed) + odd)]
    table = [(i, t, "en", None, None if t is None else len(t), "clash", -1, None) for i, t in found]
    return table + [table[3], table[7], (None, "a text without an id " * 3, None, None, None, None, None, None)]


def frame(spark, data=None, parts: int = 3):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA).repartition(parts)
