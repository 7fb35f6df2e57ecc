"""A worker-local cache that forgets the least recently used entry, with an optional time to live."""

from __future__ import annotations

import time
from collections import OrderedDict
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from lodevec.errors import ValidationError


@dataclass(frozen=True)
class CacheStats:
    hits: int
    misses: int
    evictions: int
    size: int
    max_size: int

    @property
    def hit_rate(self) -> float:
        return self.hits / (self.hits + self.misses) if self.hits + self.misses else 0.0


class LruCache:
    """Values are copied in and out. ``get`` refreshes and counts, ``has`` does neither; an expired entry is a miss."""

    def __init__(self, max_size: int = 1000, ttl: float | None = None, clock: Callable[[], float] = time.monotonic):
        if max_size < 1:
            raise ValidationError("max_size must be positive")
        self.max_size, self.ttl, self._clock = max_size, ttl, clock
        self._rows: OrderedDict[str, tuple[float, list]] = OrderedDict()
        self._hits = self._misses = self._evictions = 0

    def _fresh(self, born: float) -> bool:
        return self.ttl is None or self._clock() - born <= self.ttl

    def get(self, key: str):
        found = self._rows.get(key)
        if found is None or not self._fresh(found[0]):
            self._rows.pop(key, None)
            self._misses += 1
            return None
        self._hits += 1
        self._rows.move_to_end(key)
        return list(found[1])

    def set(self, key: str, value) -> None:
        self._rows.pop(key, None)
        while len(self._rows) >= self.max_size:
            self._rows.popitem(last=False)
            self._evictions += 1
        self._rows[key] = (self._clock(), list(value))

    def has(self, key: str) -> bool:
        return key in self._rows and self._fresh(self._rows[key][0])

    def delete(self, key: str) -> bool:
        return self._rows.pop(key, None) is not None

    def clear(self) -> None:
        self._rows.clear()
        self._hits = self._misses = self._evictions = 0

    def stats(self) -> CacheStats:
        return CacheStats(self._hits, self._misses, self._evictions, len(self._rows), self.max_size)


def warm(cache: LruCache, entries: Iterable[tuple[str, list]]) -> None:
    for key, value in entries:
        cache.set(key, value)
