"""Words, shingles and n-grams of whole Arrow batches as numpy arrays.

A word is a maximal run of ASCII letters, digits and characters beyond ASCII; callers
lower-case texts first, in Spark. Texts are taken in slices of about ``SLICE`` bytes, so
working memory does not follow the batch; one longer text forms a slice by itself.
Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
_U = np.uint64
_PERIOD = 1 << 16

WORD_BYTE = np.zeros(256, bool)
for _span in ((48, 58), (65, 91), (97, 123), (128, 256)):
    WORD_BYTE[_span[0] : _span[1]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> _U(29))
    h = h * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(32))


def constants(n: int, seed: int) -> np.ndarray:
    """``n`` odd 64-bit numbers, the same in every process."""
    return mix(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed)) | _U(1)


_BYTE = constants(256, 11)
_POWER = np.multiply.accumulate(np.full(_PERIOD, 0x5851F42D4C957F2D, dtype=_U))
_STEP = constants(64, 23)


class Slice(NamedTuple):
    first: int  # row of the batch
    data: np.ndarray  # bytes of the slice
    offsets: np.ndarray  # byte offset of each text, and the end


class Words(NamedTuple):
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    offsets: np.ndarray  # first word of each text, and the end


def slices(texts: pa.Array, limit: int = SLICE) -> Iterator[Slice]:
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    _, at, body = texts.buffers()
    offsets = np.frombuffer(at, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(body, dtype=np.uint8) if body else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield Slice(i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        i = j


def words(part: Slice) -> Words:
    inside = WORD_BYTE[part.data]
    n = len(inside)
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    cuts = part.offsets[1:-1]
    before[cuts[cuts < n]] = False
    after[cuts[cuts > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    offsets = np.searchsorted(starts, part.offsets)
    if not len(starts):
        return Words(np.zeros(0, _U), starts, ends, offsets)
    sizes = ends - starts
    heads = np.zeros(len(starts), np.int64)
    np.cumsum(sizes[:-1], out=heads[1:])
    place = np.arange(int(sizes.sum())) - np.repeat(heads, sizes)
    values = _BYTE[part.data[inside]]
    if sizes.max() >= _PERIOD:
        values = values + (place // _PERIOD).astype(_U) * _STEP[0]
        place %= _PERIOD
    hashes = mix(np.add.reduceat(values * _POWER[place], heads) + sizes.astype(_U))
    return Words(hashes, starts, ends, offsets)


def word_hash(word: str) -> int:
    """The hash ``words`` gives this word; for tables of known words."""
    part = next(slices(pa.array([word])))
    return int(words(part).hashes[0])


def owners(offsets: np.ndarray) -> np.ndarray:
    """The text of each element, from the offsets of the texts."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def shingles(w: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words and each text's offsets; a text of fewer words is one shingle."""
    counts = np.diff(w.offsets)
    made = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    offsets = np.concatenate(([0], np.cumsum(made)))
    out = np.zeros(int(offsets[-1]), _U)
    n = len(w.hashes)
    if n >= size:
        run = np.zeros(n - size + 1, _U)
        for j in range(size):
            run += w.hashes[j : n - size + 1 + j] * _STEP[j + 1]
        last = np.repeat(w.offsets[1:], counts)[: n - size + 1]
        whole = np.arange(n - size + 1) + size <= last
        out[np.repeat(counts >= size, made)] = run[whole]
    for i in np.flatnonzero((counts > 0) & (counts < size)):
        own = w.hashes[w.offsets[i] : w.offsets[i + 1]]
        out[offsets[i]] = (own * _STEP[1 : len(own) + 1]).sum(dtype=_U) + _U(len(own))
    return mix(out), offsets


def per_text(values: np.ndarray, offsets: np.ndarray, fold=np.add, empty=0) -> np.ndarray:
    """``fold`` over each text's elements; texts without elements get ``empty``."""
    full = np.diff(offsets) > 0
    out = np.full((len(offsets) - 1, *values.shape[1:]), empty, dtype=values.dtype)
    if full.any():
        out[full] = fold.reduceat(values, offsets[:-1][full], axis=0)
    return out
