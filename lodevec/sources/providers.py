"""Sources of embeddings: a protocol, an offline provider, HTTP providers, and how a table is embedded.

A provider is applied by ``mapInArrow``: a worker builds its own client, texts go in batches, and rows
keep their keys. Transports are injected, so that nothing here needs a network in tests.
"""

from __future__ import annotations

import functools
import hashlib
import json
import random
import re
import threading
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Protocol, runtime_checkable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodevec.errors import ProviderError, ValidationError
from lodevec.functions.flat import lists
from lodevec.sources.cache import LruCache
from lodevec.sources.models import REGISTRY


@dataclass(frozen=True)
class Result:
    embeddings: list[list[float]]
    model: str
    dimensions: int
    tokens: int | None = None


@runtime_checkable
class Provider(Protocol):
    name: str
    dimensions: int | None
    batch_size: int

    def embed(self, texts: list[str], input_type: str | None = None) -> Result: ...


def prefixed(texts: list[str], input_type: str | None, document: str, query: str) -> list[str]:
    mark = {"document": document, "query": query}.get(input_type or "", "")
    return [mark + t for t in texts] if mark else list(texts)


#: Slots of the tables of known trigrams and of known short words, words of each of two generations that are kept, characters whose tokens are counted at once.
TRIGRAM_SLOTS, WORD_SLOTS, MOST_WORDS, PIECE = 1 << 20, 1 << 20, 200_000, 1 << 18
#: Different characters up to which trigrams are numbered; words that are looked up by name at once, few enough for the processor's cache.
LETTERS, RUN = 128, 1 << 13
#: Bytes of a short word: two numbers of 64 bits hold them and their count.
SHORT = 15

_known: list[np.ndarray] = []  # codes and hashes of trigrams by slot, both numbers and hashes of short words by slot: a newer one takes the slot of an older one
_words: dict[str, int] = {}
_older: dict[str, int] = {}  # the generation before: its words that are met again go over to the new one
_lookup = threading.Lock()


def _token_hash(token: str) -> int:
    return int.from_bytes(hashlib.blake2b(token.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def _word_hashes(words: list[str]) -> np.ndarray:
    """The hash of each word; equal ones are looked up once."""
    global _words, _older
    with _lookup:
        own = list(set(words))
        found = list(map(_words.get, own))
        for i, h in enumerate(found):
            if h is None:
                w = own[i]
                found[i] = h = _older.get(w)
                if h is None:
                    found[i] = h = _token_hash(w)
                if len(w) <= 32:
                    if len(_words) >= MOST_WORDS:
                        _words, _older = {}, _words
                    _words[w] = h
    return np.fromiter(map(dict(zip(own, found)).__getitem__, words), np.uint64, len(words))


def _tables() -> list[np.ndarray]:
    if not _known:
        _known.extend((np.full(TRIGRAM_SLOTS, -1, np.int64).view(np.uint64), *(np.zeros(n, np.uint64) for n in (TRIGRAM_SLOTS, WORD_SLOTS, WORD_SLOTS, WORD_SLOTS))))
    return _known


#: Spaces of one byte, at which ``str.split`` parts words, and beginnings of the longer ones (and of some other characters).
_SPACE = np.array([chr(i).isspace() and i < 128 for i in range(256)])
_WIDE_SPACES = [c.encode() for c in "\x85\xa0\u1680\u205f\u3000"] + [b"\xe2\x80"]
_ANY_SPACE = re.compile(r"\s")
#: The lowest bytes of a number, by their count.
_LOWEST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def _parted(text: str) -> Iterator[str]:
    """The text, cut before spaces into parts of about PIECE characters."""
    at = 0
    while len(text) - at > PIECE and (space := _ANY_SPACE.search(text, at + PIECE)):
        yield text[at : space.start()]
        at = space.start()
    yield text[at:]


def _words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(number of words of each text, hashes of the words of all texts in turn), without a Python object for each word.

    A short word is looked up by its bytes, in two numbers; only those not found and long ones become strings.
    """
    coded = [t.encode("utf-8", "surrogatepass") for t in texts]
    for i, t in enumerate(texts):
        if not t.isascii() and any(c in coded[i] for c in _WIDE_SPACES):
            coded[i] = " ".join(t.split()).encode("utf-8", "surrogatepass")
    data = np.frombuffer(b"".join((b" ", b" ".join(coded), b" " * 17)), np.uint8)
    space = _SPACE[data]
    starts, ends = np.flatnonzero(space[:-1] & ~space[1:]) + 1, np.flatnonzero(~space[:-1] & space[1:]) + 1
    begins = np.cumsum([1, *(len(c) + 1 for c in coded)])
    counts = np.diff(np.searchsorted(starts, begins))
    size = ends - starts
    eight = np.lib.stride_tricks.sliding_window_view(data, 8)
    low = eight[starts].view("<u8").ravel() & _LOWEST[np.minimum(size, 8)]
    high = eight[starts + 8].view("<u8").ravel() & _LOWEST[np.clip(size - 8, 0, 7)] | np.minimum(size, 255).astype(np.uint64) << np.uint64(56)
    slot = (((low ^ high * np.uint64(0xD6E8FEB86659FD93)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % WORD_SLOTS
    with _lookup:
        lows, highs, hashes = _tables()[2:]
        out, new = hashes[slot], (lows[slot] != low) | (highs[slot] != high) | (size > SHORT)
    new = np.flatnonzero(new)
    if len(new):
        there = np.zeros(len(data) + 1, np.int8)
        there[starts[new]] = 1
        there[ends[new] + 1] -= 1  # with the space behind it
        words = data[np.cumsum(there[:-1], dtype=np.int8).view(bool)].tobytes().decode("utf-8", "surrogatepass").split()
        out[new] = np.concatenate([_word_hashes(words[at : at + RUN]) for at in range(0, len(words), RUN)])
        new = new[size[new] <= SHORT]
        at = slot[new]
        with _lookup:
            lows[at], highs[at], hashes[at] = low[new], high[new], out[new]
    return counts, out


def _trigram_hashes(codes: np.ndarray) -> np.ndarray:
    """The hash of each trigram (three code points of 21 bits): of the table, or computed once for all equal ones."""
    with _lookup:
        own, hashes = _tables()[:2]
        slot = ((codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64) % TRIGRAM_SLOTS
        out, new = hashes[slot], own[slot] != codes
        if new.any():
            codes, back = np.unique(codes[new], return_inverse=True)
            found = np.array([_token_hash("".join(chr(c >> at & 0x1FFFFF) for at in (42, 21, 0))) for c in codes.tolist()], np.uint64)
            out[new] = found[back]
            at = np.zeros(len(codes), np.int64)
            at[back] = slot[new]
            own[at], hashes[at] = codes, found
    return out


def _coded(points: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray | slice]:
    """(trigrams of a row of code points, the place among them of each that begins where ``inner`` is set).

    Up to LETTERS different characters, trigrams are numbered by the characters' own numbers and equal ones are given once.
    """
    there = np.zeros(int(points.max()) + 1, bool)
    there[points] = True
    letters = np.flatnonzero(there).astype(np.uint64)
    n = len(letters)
    if n > LETTERS:
        wide = points.astype(np.uint64)
        return (wide[:-2] << np.uint64(42) | wide[1:-1] << np.uint64(21) | wide[2:])[inner], slice(None)
    number = np.empty(len(there), np.int32)
    number[letters.astype(np.int64)] = np.arange(n)
    own = number[points]
    own = ((own[:-2] * n + own[1:-1]) * n + own[2:])[inner]
    there = np.zeros(n**3, bool)
    there[own] = True
    numbers = np.flatnonzero(there)
    place = np.empty(n**3, np.int32)
    place[numbers] = np.arange(len(numbers))
    return letters[numbers // n**2] << np.uint64(42) | letters[numbers // n % n] << np.uint64(21) | letters[numbers % n], place[own]


def _token_sums(texts: list[str], dimensions: int) -> np.ndarray:
    """For each text the sum of its hashed words and trigrams, which are whole numbers: each adds 1 or -1 in one dimension."""
    out = np.zeros((len(texts), dimensions))

    def count(rows: np.ndarray, places: np.ndarray) -> None:
        n = np.bincount(rows * (2 * dimensions) + places, minlength=2 * out.size)
        out.ravel()[:] += n[1::2] - n[::2]

    def places(hashes: np.ndarray) -> np.ndarray:
        """Twice the dimension, and 1 if it counts as positive."""
        return (hashes % np.uint64(dimensions) * np.uint64(2) + (hashes >> np.uint64(63))).astype(np.int64)

    def trigrams(group: list[tuple[int, str]]) -> None:
        points = np.frombuffer("".join(t for _, t in group).encode("utf-32-le", "surrogatepass"), np.uint32)
        if len(points) < 3:
            return
        sizes = np.array([len(t) for _, t in group])
        ends, inner = np.cumsum(sizes), np.ones(len(points), bool)
        inner[ends - 1] = inner[ends - 2] = False  # those that don't end in their own text
        inner = inner[:-2]
        codes, place = _coded(points, inner)
        count(np.repeat([i for i, _ in group], sizes)[:-2][inner], places(_trigram_hashes(codes))[place])

    def words(group: list[tuple[int, str]]) -> None:
        counts, hashes = _words_of([t for _, t in group])
        count(np.repeat([i for i, _ in group], counts), places(hashes))

    whole, waiting, group, size = [], 0, [], 0
    for i, t in enumerate(texts):
        low = t.lower()
        for part in _parted(low):
            whole.append((i, part))
            waiting += len(part)
            if waiting >= PIECE:
                words(whole)
                whole, waiting = [], 0
        for at in range(0, max(1, len(low) - 2), PIECE):
            part = low[at : at + PIECE + 2]
            group.append((i, part))
            size += len(part)
            if size >= PIECE:
                trigrams(group)
                group, size = [], 0
    if whole:
        words(whole)
    if group:
        trigrams(group)
    return out


@dataclass
class HashProvider:
    """A deterministic offline provider: hashed words and letter trigrams, summed and of unit length."""

    dimensions: int = 64
    document_prefix: str = ""
    query_prefix: str = ""
    name: str = "hash"
    batch_size: int = 256

    def embed(self, texts: list[str], input_type: str | None = None) -> Result:
        if not texts:
            raise ValidationError("there is no text to embed")
        out = _token_sums(prefixed(texts, input_type, self.document_prefix, self.query_prefix), self.dimensions)
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        out = np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)
        return Result(out.astype(np.float32).tolist(), f"{self.name}-{self.dimensions}", self.dimensions)


@dataclass
class LocalProvider:
    """A model in the worker: ``load(model)`` gives a function of texts to token vectors, which are pooled by mean.

    The model is loaded at the first call; whole calls of one text are kept in ``cache``.
    """

    load: Callable[[str], Callable[[list[str]], list[np.ndarray]]]
    model: str
    dimensions: int | None = None
    document_prefix: str | None = None
    query_prefix: str | None = None
    cache: LruCache | None = None
    batch_size: int = 32
    name: str = "local"
    _run: Callable | None = field(default=None, repr=False)

    def __post_init__(self):
        info = REGISTRY.get(self.model)
        self._own = dict(info.prefixes) if info else {}
        self.dimensions = self.dimensions or (info.dimensions if info else None)

    def embed(self, texts: list[str], input_type: str | None = None) -> Result:
        if not texts:
            raise ValidationError("there is no text to embed")
        self._run = self._run or self.load(self.model)
        document, query = (given if given is not None else self._own.get(kind, "") for given, kind in ((self.document_prefix, "document"), (self.query_prefix, "query")))
        out = []
        for t in prefixed(texts, input_type, document, query):
            v = self.cache.get(t) if self.cache else None
            if v is None:
                v = np.asarray(self._run([t])[0], float).mean(0)
                v = v[: self.dimensions] if self.dimensions else v
                norm = np.linalg.norm(v)
                v = (v / norm if norm else v).astype(np.float32).tolist()
                if self.cache:
                    self.cache.set(t, v)
            out.append(list(v))
        return Result(out, self.model, len(out[0]))


def retryable(error: Exception) -> bool:
    return isinstance(error, ProviderError) and error.status_code is not None and (error.status_code == 429 or error.status_code >= 500)


def retry_with_backoff(call: Callable, retries: int = 3, base: float = 1.0, longest: float = 30.0, deadline: float | None = None, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic):
    """Calls again after 429 and 5xx answers, after min(base * 2**n * (1 to 1.3), longest) seconds, until the deadline."""
    for n in range(retries + 1):
        try:
            return call()
        except ProviderError as e:
            wait = min(base * 2**n * (1 + random.random() * 0.3), longest)
            if n == retries or not retryable(e) or (deadline is not None and clock() + wait > deadline):
                raise
            sleep(wait)
    raise AssertionError


def in_pool(tasks: list[Callable[[], object]], limit: int, on_done: Callable[[int], None] | None = None) -> list:
    """Results of tasks in order, at most ``limit`` at a time. After the first failure no further task begins."""
    if limit < 1:
        raise ValidationError("concurrency must be positive")
    out: list = [None] * len(tasks)
    failed, lock, ahead, done = threading.Event(), threading.Lock(), iter(range(len(tasks))), 0

    def run() -> None:
        nonlocal done
        while not failed.is_set():
            with lock:
                i = next(ahead, None)
            if i is None:
                return
            try:
                out[i] = tasks[i]()
                with lock:
                    done += 1
                    if on_done:
                        on_done(done)
            except BaseException:
                failed.set()
                raise

    with ThreadPoolExecutor(max(1, min(limit, len(tasks)))) as pool:
        for worker in [pool.submit(run) for _ in range(min(limit, len(tasks)))]:
            worker.result()
    return out


def auto_batch(texts: list[str], size: int, call: Callable[[list[str]], list], concurrency: int = 1, delay: float = 0.0, on_progress: Callable[[int, int], None] | None = None) -> list:
    """Results of slices of ``size`` texts, in order; in a pool if ``concurrency`` is over 1, else with a delay between them."""
    if size < 1 or concurrency < 1:
        raise ValidationError("size and concurrency must be positive")
    parts = [texts[i : i + size] for i in range(0, len(texts), size)]
    tell = None if on_progress is None else lambda n: on_progress(n, len(parts))
    if concurrency > 1:
        return [x for r in in_pool([functools.partial(call, p) for p in parts], concurrency, tell) for x in r]
    out: list = []
    for n, part in enumerate(parts):
        if n and delay:
            time.sleep(delay)
        out += call(part)
        if tell:
            tell(n + 1)
    return out


def http_post(url: str, headers: dict, body: dict, timeout: float) -> tuple[int, dict]:
    """(status, JSON answer) of a POST; the default transport."""
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as r:
            return r.status, json.loads(r.read())
    except urllib.error.HTTPError as e:
        return e.code, {"error": e.read().decode("utf-8", "replace")}


@dataclass
class HttpProvider:
    """Embeddings over HTTP; ``shape`` makes a batch's body, ``read`` takes (vectors, tokens) from the answer."""

    name: str
    url: str
    model: str
    shape: Callable[[list[str], str | None], dict]
    read: Callable[[dict], tuple[list, int | None]]
    key: str | Callable[[], str]
    batch_size: int = 100
    dimensions: int | None = None
    retries: int = 3
    timeout: float = 30.0
    post: Callable = http_post

    def embed(self, texts: list[str], input_type: str | None = None) -> Result:
        if not texts:
            raise ValidationError("there is no text to embed")
        deadline = time.monotonic() + self.timeout  # bounds all attempts together
        tokens: list[int] = []

        def once(part: list[str]) -> list:
            token = self.key() if callable(self.key) else self.key
            left = max(0.001, deadline - time.monotonic())
            try:
                status, answer = self.post(self.url, {"Authorization": f"Bearer {token}"}, self.shape(part, input_type), left)
            except TimeoutError as e:
                raise ProviderError(f"no answer within {self.timeout} s", self.name) from e
            if status >= 400:
                raise ProviderError(f"status {status}: {answer.get('error', '')}", self.name, status)
            try:
                vectors, used = self.read(answer)
            except (KeyError, TypeError, IndexError) as e:
                raise ProviderError("the answer has no embeddings", self.name) from e
            if len(vectors) != len(part):
                raise ProviderError(f"{len(part)} texts gave {len(vectors)} embeddings", self.name)
            if used is not None:
                tokens.append(used)
            return vectors

        out = auto_batch(texts, self.batch_size, lambda part: retry_with_backoff(lambda: once(part), self.retries, deadline=deadline))
        return Result(out, self.model, len(out[0]), sum(tokens) if tokens else None)


def openai_compatible(api_key: str, model: str, base_url: str = "https://api.openai.com/v1", dimensions: int | None = None, name: str = "openai-compatible", max_batch: int = 2048, **rest) -> HttpProvider:
    if not api_key:
        raise ValidationError("an API key is needed")
    shape = lambda texts, _: {"model": model, "input": texts} | ({"dimensions": dimensions} if dimensions else {})
    read = lambda a: ([d["embedding"] for d in sorted(a["data"], key=lambda d: d["index"])], a.get("usage", {}).get("total_tokens"))
    return HttpProvider(name, f"{base_url.rstrip('/')}/embeddings", model, shape, read, api_key, max_batch, dimensions, **rest)


def cohere(api_key: str, model: str = "embed-english-v3.0", base_url: str = "https://api.cohere.com/v1", **rest) -> HttpProvider:
    if not api_key:
        raise ValidationError("an API key is needed")
    kinds = {"document": "search_document", "query": "search_query"}
    shape = lambda texts, kind: {"model": model, "texts": texts, "input_type": kinds.get(kind or "document", "search_document")}
    read = lambda a: (a["embeddings"], a.get("meta", {}).get("billed_units", {}).get("input_tokens"))
    return HttpProvider("cohere", f"{base_url.rstrip('/')}/embed", model, shape, read, api_key, 96, **rest)


def google_vertex(project: str, access_token: str | Callable[[], str], location: str = "us-central1", model: str = "text-embedding-004", **rest) -> HttpProvider:
    if not project:
        raise ValidationError("a project is needed")
    url = f"https://{location}-aiplatform.googleapis.com/v1/projects/{project}/locations/{location}/publishers/google/models/{model}:predict"
    shape = lambda texts, _: {"instances": [{"content": t} for t in texts]}

    def read(a: dict) -> tuple[list, int | None]:
        found = [p["embeddings"] for p in a["predictions"]]
        counts = [e.get("statistics", {}).get("token_count") for e in found]
        return [e["values"] for e in found], sum(c for c in counts if c) or None

    return HttpProvider("google-vertex", url, model, shape, read, access_token, 5, **rest)


_BASES = {
    "openai": "https://api.openai.com/v1", "voyage": "https://api.voyageai.com/v1", "mistral": "https://api.mistral.ai/v1", "jina": "https://api.jina.ai/v1",
    "together": "https://api.together.xyz/v1", "fireworks": "https://api.fireworks.ai/inference/v1", "nomic": "https://api-atlas.nomic.ai/v1", "mixedbread": "https://api.mixedbread.ai/v1",
}


def create_provider(kind: str, **config) -> Provider:
    """A provider by its type: local, openai-compatible or one of its named services, cohere, google-vertex, hash."""
    if kind in _BASES:
        return openai_compatible(**{"base_url": _BASES[kind], "name": kind, **config})
    makers = {"local": LocalProvider, "openai-compatible": openai_compatible, "cohere": cohere, "google-vertex": google_vertex, "hash": HashProvider}
    if kind not in makers:
        raise ValidationError(f"unknown provider {kind!r}")
    return makers[kind](**config)


@dataclass
class CachedProvider:
    """Keeps single texts by provider, dimensions, input type and text; only the missing ones are asked for."""

    inner: Provider
    cache: LruCache

    def __post_init__(self):
        self.name, self.dimensions, self.batch_size = self.inner.name, self.inner.dimensions, self.inner.batch_size

    def embed(self, texts: list[str], input_type: str | None = None) -> Result:
        keys = [f"{self.name}:{self.dimensions}:{input_type}:{t}" for t in texts]
        found = [self.cache.get(k) for k in keys]
        missing = [i for i, v in enumerate(found) if v is None]
        model, tokens = self.name, None
        if missing:
            new = self.inner.embed([texts[i] for i in missing], input_type)
            model, tokens = new.model, new.tokens
            for i, v in zip(missing, new.embeddings):
                self.cache.set(keys[i], v)
                found[i] = v
        return Result(found, model, len(found[0]) if found else 0, tokens)


def with_cache(provider: Provider, max_size: int = 1000, ttl: float | None = None) -> CachedProvider:
    return CachedProvider(provider, LruCache(max_size, ttl))


def embed(df: DataFrame, provider: Provider, keys: Iterable[str] | None = None, text: str = "text", input_type: str | None = None, concurrency: int = 1) -> DataFrame:
    """``df`` (or its columns ``keys``) with the column embedding; a null text has a null embedding.

    A narrow step: nothing is shuffled. The provider travels with the function and must be picklable; each
    task has up to ``concurrency`` calls to it under way.
    """
    rest = list(keys) if keys is not None else [c for c in df.columns if c != "embedding"]
    rows = df.select(*rest, F.col(text).cast("string").alias("__text"))
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in rest)

    def work(batches):
        for b in batches:
            texts = b.column(len(rest)).to_pylist()
            out: list = [None] * len(texts)
            real = [i for i, t in enumerate(texts) if t is not None]
            call = lambda part: provider.embed(part, input_type).embeddings
            for i, v in zip(real, auto_batch([texts[i] for i in real], provider.batch_size, call, concurrency)):
                out[i] = v
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in range(len(rest))), pa.array(out, pa.list_(pa.float32()))], names=[*rest, "embedding"])

    return rows.mapInArrow(work, f"{kinds}, embedding array<float>")


def project(df: DataFrame, matrix: np.ndarray, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, projected): vectors times the transpose of ``matrix``, summed in doubles."""
    wide = matrix.astype(np.float64).T

    @F.arrow_udf("array<float>")
    def times(v: pa.Array) -> pa.Array:
        good = v.drop_null()
        if not len(good):
            return pa.nulls(len(v), pa.list_(pa.float32()))
        flat = (good.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(good), -1) @ wide).astype(np.float32)
        valid = v.is_valid().to_numpy(zero_copy_only=False)
        return lists(flat.ravel(), np.where(valid, flat.shape[1], 0), valid)

    return df.select(key, times(F.col(vector)).alias("projected"))
