"""Vectorised text features over Arrow string buffers.

Everything here works on the UTF-8 bytes that Spark hands to a worker, without making a Python
string per text: words are byte spans, and the hash of any span is a difference of two prefix sums
of a polynomial modulo 2**64. Texts are taken whole; a batch is only cut between texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are worked on in runs of about so many bytes, which bounds a worker's memory.
RUN_BYTES = 1 << 19
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

_letters = np.zeros(256, bool)
_letters[0x80:] = True
for _a, _b in (("a", "z"), ("A", "Z")):
    _letters[ord(_a) : ord(_b) + 1] = True
LETTER = _letters.copy()
WORD = _letters.copy()
WORD[ord("0") : ord("9") + 1] = True
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


@cache
def _powers(n: int, inverse: bool) -> np.ndarray:
    out = np.full(n, _P_INV if inverse else _P, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _upto(n: int, inverse: bool) -> np.ndarray:
    return _powers(max(1 << 16, 1 << int(n - 1).bit_length()), inverse)[:n]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the len + 1 offsets into them. A null counts as an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count or not (pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type)):
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def runs(texts: pa.Array, run_bytes: int = RUN_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, offsets) of runs of whole texts of about ``run_bytes``; one longer text is a run."""
    data, offsets = buffers(texts)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + run_bytes, side="right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


class Hasher:
    """Hashes of arbitrary byte spans of one run."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _upto(max(1, len(data)), False)[: len(data)], out=self.sums[1:])
        self.inverse = _upto(len(data) + 1, True)

    def __call__(self, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start] + np.uint64((seed * 0xD1B54A32D192ED03) % 2**64))


def spans(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text number) of the maximal stretches of bytes of a kind; none crosses two texts."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    inside = kind[data]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    before[edges] = False
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def per_text(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Sums of values by text number."""
    return np.bincount(owner, weights=values, minlength=n)


def owners(offsets: np.ndarray) -> np.ndarray:
    """The text number of every byte."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def lower(texts: pa.Array) -> pa.Array:
    """Lower case by Unicode; a null stays null."""
    return pc.utf8_lower(texts)
