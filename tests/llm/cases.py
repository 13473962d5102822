"""Small tables with the awkward rows every operator must take."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# Columns an operator might use for itself.
CLASHING = ["kept", "component", "id", "key", "part", "line", "_gone", "_hit", "_doc", "_lines", "_cut", "ids", "decoded", "n", "h"]

WORDS = [f"{a}{b}" for a in ("al", "be", "cor", "du", "en", "fi", "gor", "hu", "ix", "jo") for b in ("ma", "ne", "lit", "ros", "tu")]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(rng: random.Random, text: str, edits: int) -> str:
    words = text.split(" ")
    for _ in range(edits):
        words[rng.randrange(len(words))] = rng.choice(WORDS) + "x"
    return " ".join(words)


def awkward(seed: int = 1, long_words: int = 3000) -> list[tuple]:
    """Null, empty, blank and very long texts, exact and near copies, repeated rows, a missing id."""
    rng = random.Random(seed)
    base = [prose(rng, rng.randrange(3, 120)) for _ in range(25)]
    texts: list[str | None] = [None, "", " \t\n ", ".", "a", "a b", "Été ÀÉ été", "x" * 5000, prose(rng, long_words)]
    texts += base + [base[0]] * 5 + [base[1].upper()] + [edited(rng, b, 1) for b in base for _ in range(2)]
    texts += ["\n".join(rng.sample(base, 4)) for _ in range(5)] + ["😀 \u200bz\u0301 \ufffd ‹tags›\r\nend"]
    rows = [(i * 3 + 1, t, None if t is None else "xx", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[12], rows[12], (rows[14][0], base[7], "xx", None, None), (None, base[8], None, None, None), (None, None, None, None, None)]
    rng.shuffle(rows)
    return rows


def frame(spark, rows, clashing: bool = False, parts: int = 3):
    df = spark.createDataFrame(rows, SCHEMA)
    if clashing:
        from pyspark.sql import functions as F

        df = df.select(*df.columns, *[F.lit(i).alias(c) for i, c in enumerate(CLASHING)])
    return df.repartition(parts)


def plain(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)
