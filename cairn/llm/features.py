"""Dense text features that the quality and toxicity classifiers share."""

from __future__ import annotations

import numpy as np

from cairn.llm import textvec as V

# Byte classes: lower, upper, digit, beyond ASCII, space, line end, sentence marks, other signs.
CLASS = np.full(256, 7, np.int64)
CLASS[97:123], CLASS[65:91], CLASS[48:58], CLASS[128:256] = 0, 1, 2, 3
CLASS[[32, 9]], CLASS[[10, 13]], CLASS[[ord(c) for c in ".,;:!?'\""]] = 4, 5, 6
CLASSES = 8


def class_shares(part: V.Slice) -> np.ndarray:
    """Shares of byte-class pairs in each text."""
    texts, n = len(part.offsets) - 1, len(part.data)
    out = np.zeros((texts, CLASSES * CLASSES))
    if n > 1:
        kind = CLASS[part.data]
        owner = V.owners(part.offsets)
        same = owner[1:] == owner[:-1]
        pair = owner[1:] * CLASSES * CLASSES + kind[:-1] * CLASSES + kind[1:]
        out = np.bincount(pair[same], minlength=out.size).reshape(out.shape).astype(float)
    return out / np.maximum(out.sum(1, keepdims=True), 1)


def ratio(a, b) -> np.ndarray:
    return np.asarray(a, float) / np.maximum(b, 1)


def word_counts(part: V.Slice, w: V.Words) -> dict[str, np.ndarray]:
    """Counts and lengths of each text's words, and of what stands around them."""
    texts = len(part.offsets) - 1
    owner = V.owners(w.offsets)
    words, sizes = np.diff(w.offsets), w.ends - w.starts
    total = lambda x: np.bincount(owner, x, texts) if len(owner) else np.zeros(texts)
    kind = CLASS[part.data]
    by_class = np.zeros((texts, CLASSES))
    if len(kind):
        by_class = np.bincount(V.owners(part.offsets) * CLASSES + kind, minlength=by_class.size).reshape(by_class.shape)
    again = np.zeros(len(owner), bool)
    again[1:] = (w.hashes[1:] == w.hashes[:-1]) & (owner[1:] == owner[:-1])
    # Words followed by two signs or more, and gaps of several characters.
    after = np.minimum(w.ends + 1, max(len(kind) - 1, 0))
    signed = (kind[np.minimum(w.ends, len(kind) - 1)] >= 6) & (kind[after] >= 6) if len(owner) else again
    distinct = np.zeros(texts)
    for i in np.flatnonzero(words):
        distinct[i] = len(np.unique(w.hashes[w.offsets[i] : w.offsets[i + 1]]))
    return {
        "bytes": np.diff(part.offsets), "words": words, "letters": total(sizes), "squares": total(sizes.astype(float) ** 2), "long": total(sizes > 14), "again": total(again),
        "signed": total(signed), "distinct": distinct, "classes": by_class,
    }
