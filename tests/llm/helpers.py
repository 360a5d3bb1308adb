"""Small document tables with every odd case, and prose."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality long, toxic long"
#: Names that an operator might use itself.
EXTRA = ["rid", "size", "_row", "node", "kept", "text_sha256", "sub", "copies", "p", "n"]


def prose(rng: random.Random, words: int, start: str = "") -> str:
    parts = ["the", "of", "and", "ing", "tion", "er", "on", "an", "re", "th", "ed", "nd", "ha", "es", "to", "nt", "ou", "ea", "st", "en"]
    out = []
    for i in range(words):
        w = "".join(rng.choice(parts) for _ in range(rng.randint(1, 4)))
        out.append((w.capitalize() if i % 9 == 0 else w) + (".\n" if i % 31 == 30 else "." if i % 9 == 8 else ""))
    return start + " ".join(out)


def table(spark, rows, extra: bool = False):
    """rows: (doc_id, text[, lang[, source]])."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or "")) for r in rows]
    df = spark.createDataFrame(full, DOCS)
    if extra:
        from pyspark.sql import functions as F

        for name in EXTRA:
            df = df.withColumn(name, F.lit("x"))
    return df


def odd(rng: random.Random) -> list[tuple]:
    """Null, empty, blank and very long texts, ties, repeated rows, null columns."""
    a, b = prose(rng, 120), prose(rng, 80)
    return [
        (0, a), (1, None), (2, ""), (3, " \n\t "), (4, a.replace(" ", "  ")), (5, prose(rng, 20_000)), (6, b, None, None), (6, b, None, None), (7, "x" * 30_000), (8, "one two"), (9, "one  two"),
        (10, a + " " + prose(rng, 3)), (11, "é" * 40 + " naïve 😀 words"), (None, b), (None, None), (12, "One two"), (13, b, "de", None),
    ]
