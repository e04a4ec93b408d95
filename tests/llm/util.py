"""Small document tables with the awkward rows every operator must take."""

import hashlib
import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WIDE = SCHEMA + ", _salt int, score double, kept boolean, cls string, key string, size int, features string"


def prose(seed, words, vocabulary=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(words))


def awkward():
    long_text = prose(1, 30_000)
    return [
        (1, "same text here", "en", "a", 14), (2, "same text here", "en", "a", 14), (2, "same text here", "en", "a", 14),
        (3, None, None, None, None), (4, "", "de", "", 0), (None, "same text here", None, "b", None), (None, None, "en", "b", 3),
        (5, long_text, "fr", "c", len(long_text)), (6, long_text + " tail", "fr", "c", None), (7, long_text, None, "c", 1),
        (8, "  \t\n ", "en", None, 4), (9, "é" * 70, "fr", "a", 70), (10, "é" * 70 + "!", "fr", "a", 71), (11, "€uro 🎈 text", "es", "d", 11),
        (3, "other text for a repeated id", "en", "a", 1),
    ]


def frame(spark, rows, wide=False):
    if wide:
        return spark.createDataFrame([(*r, 7, 0.5, False, "x", "k", 3, "f") for r in rows], WIDE)
    return spark.createDataFrame(rows, SCHEMA)


def sha(text):
    return hashlib.sha256((text or "").encode()).hexdigest()
