"""Token ids of whole texts in a worker, by a public SentencePiece model and a bounded cache of words.

No merge of such a model crosses a word's end, so a text is encoded word by word (see ``lattice``). Words are
spans of bytes, known by a 64-bit hash in a table of two ways; only those that the worker doesn't know are
given to the library. Ids are exactly the library's, but for two words of one worker that share a hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import sentencepiece

from lodevec.llm.lattice import _spaced_runs, _take_spans, table, word_spans
from lodevec.llm.textbytes import Hasher

#: Slots of the table as a power of two, and ids that a worker keeps; memory only, the ids don't depend on it.
SLOT_BITS, CACHE_IDS = 20, 8_000_000


class WordEncoder:
    def __init__(self, model: str):
        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.vocab, self.cuts = self.sp.vocab_size(), table(model).cuts
        self._newline = len(self.sp.encode("\n"))
        self._clear()

    def _clear(self) -> None:
        slots = 1 << SLOT_BITS
        self.hash, self.first, self.size = np.zeros(slots, np.uint64), np.zeros(slots, np.int64), np.zeros(slots, np.int32)
        self.ids, self.used = np.zeros(1 << 16, np.int32), 0

    def _slots(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mask = np.uint64((1 << SLOT_BITS) - 1)
        return (h & mask).astype(np.int64), (h >> np.uint64(32) & mask).astype(np.int64)

    def _learn(self, h: np.ndarray, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(first id, number of ids) of words with different hashes, which are kept from now on."""
        # the library puts a space before a text that isn't empty; other words follow a line end, which joins nothing
        leads = [w[0] == " " and w != " " for w in words]
        found = self.sp.encode([w[1:] if lead else "\n" + w for w, lead in zip(words, leads)], num_threads=1)
        found = [ids if lead else ids[self._newline :] for ids, lead in zip(found, leads)]
        n = np.fromiter(map(len, found), np.int64, len(found))
        total = self.used + int(n.sum())
        if total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(total, np.int32)])
        self.ids[self.used : total] = np.fromiter((x for w in found for x in w), np.int32, total - self.used)
        first = self.used + np.cumsum(n) - n
        self.used = total
        one, two = self._slots(h)
        at = np.where((self.hash[one] == 0) | (self.hash[two] != 0), one, two)
        self.hash[at], self.first[at], self.size[at] = h, first, n
        return first, n

    def __call__(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first text, last text, ids one after another, number of ids of each text) of runs of whole texts."""
        for i, j, data, offsets in _spaced_runs(texts):
            start, end, owner = word_spans(data, offsets, self.cuts)
            h = Hasher(data)(start, end, 11) | np.uint64(1 << 63)  # 0 is an empty slot
            if self.used > CACHE_IDS:
                self._clear()
            one, two = self._slots(h)
            slot = np.where(self.hash[one] == h, one, two)
            first, n = self.first[slot], self.size[slot].astype(np.int64)
            lost = np.flatnonzero(self.hash[slot] != h)
            if len(lost):
                own, at, back = np.unique(h[lost], return_index=True, return_inverse=True)
                new_first, new_n = self._learn(own, _take_spans(data, start[lost[at]], end[lost[at]]).to_pylist())
                first[lost], n[lost] = new_first[back], new_n[back]
            stop = np.cumsum(n)
            ids = self.ids[np.repeat(first - (stop - n), n) + np.arange(int(stop[-1]) if len(stop) else 0)]
            yield i, j, ids, np.bincount(owner, weights=n, minlength=j - i).astype(np.int64)


@cache
def encoder(model: str) -> WordEncoder:
    return WordEncoder(model)
