"""Resumable embedding of tables and streams: done rows are skipped, the provider's rate is kept."""

from __future__ import annotations

import functools
import json
import threading
import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from pathlib import Path
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodevec.errors import ValidationError
from lodevec.sources.providers import Provider, Result, embed, in_pool


def batches(items: Iterable, size: int) -> Iterator[list]:
    if size < 1:
        raise ValidationError("the size of a batch must be positive")
    part: list = []
    for x in items:
        part.append(x)
        if len(part) == size:
            yield part
            part = []
    if part:
        yield part


class RateLimiter:
    """Two buckets, requests and tokens a minute, refilled continuously. A request above a full bucket is refused."""

    def __init__(self, requests_per_minute: float | None = None, tokens_per_minute: float | None = None, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.limits = (requests_per_minute, tokens_per_minute)
        if any(x is not None and x <= 0 for x in self.limits):
            raise ValidationError("rates must be positive")
        self._clock, self._sleep = clock, sleep
        self._left = [float(x) if x is not None else 0.0 for x in self.limits]
        self._at = clock()

    def wait(self, tokens: float = 0) -> None:
        need = (1.0, float(tokens))
        if any(top is not None and n > top for top, n in zip(self.limits, need)):
            raise ValidationError(f"a request of {tokens} tokens never fits the rate")
        while True:
            now = self._clock()
            for i, top in enumerate(self.limits):
                if top is not None:
                    self._left[i] = min(top, self._left[i] + (now - self._at) * top / 60)
            self._at = now
            lacks = [(n - self._left[i]) * 60 / top for i, (top, n) in enumerate(zip(self.limits, need)) if top is not None and n > self._left[i] + 1e-9]
            if not lacks:
                self._left = [left - n if top is not None else left for left, n, top in zip(self._left, need, self.limits)]
                return
            self._sleep(max(0.01, max(lacks)))


@dataclass
class LimitedProvider:
    """A provider that waits for its share of the rate in every worker; a batch costs its characters."""

    inner: Provider
    requests_per_minute: float | None = None
    tokens_per_minute: float | None = None
    _limiter: RateLimiter | None = field(default=None, repr=False)

    def __post_init__(self):
        self.name, self.dimensions, self.batch_size = self.inner.name, self.inner.dimensions, self.inner.batch_size

    def embed(self, texts: list[str], input_type: str | None = None) -> Result:
        self._limiter = self._limiter or RateLimiter(self.requests_per_minute, self.tokens_per_minute)
        self._limiter.wait(sum(map(len, texts)))
        return self.inner.embed(texts, input_type)

    def __getstate__(self):
        return {**self.__dict__, "_limiter": None}


class CheckpointAdapter(Protocol):
    def save(self, state: dict) -> None: ...

    def load(self) -> dict | None: ...


@dataclass
class FileCheckpoint:
    """The state of a driver-side run as a JSON file."""

    path: str

    def save(self, state: dict) -> None:
        Path(self.path).write_text(json.dumps(state))

    def load(self) -> dict | None:
        p = Path(self.path)
        return json.loads(p.read_text()) if p.exists() else None


@dataclass(frozen=True)
class Progress:
    done_batches: int
    batches: int
    seconds: float


@dataclass
class EmbeddingPipeline:
    provider: Provider
    batch_size: int = 100
    requests_per_minute: float | None = None
    tokens_per_minute: float | None = None
    checkpoint: CheckpointAdapter | None = None
    checkpoint_interval: int = 10
    on_progress: Callable[[Progress], None] | None = None
    concurrency: int = 1

    def __post_init__(self):
        if self.batch_size < 1 or self.checkpoint_interval < 1 or self.concurrency < 1:
            raise ValidationError("batch_size, checkpoint_interval and concurrency must be positive")

    def _limited(self, tasks: int) -> Provider:
        if self.requests_per_minute is None and self.tokens_per_minute is None:
            return self.provider
        share = lambda x: None if x is None else x / max(1, tasks)
        return LimitedProvider(self.provider, share(self.requests_per_minute), share(self.tokens_per_minute))

    def embed(self, rows: DataFrame, done: DataFrame | None = None) -> DataFrame:
        """(id, embedding) of the rows (id, text) whose id isn't in ``done``; null ids are left out."""
        new = rows.where(F.col("id").isNotNull())
        if done is not None:
            new = new.join(done.select("id"), "id", "left_anti")
        return embed(new, self._limited(rows.sparkSession.sparkContext.defaultParallelism), keys=["id"], concurrency=self.concurrency)

    def run_into(self, rows: DataFrame, path: str) -> int:
        """Appends what is missing to the Parquet table at ``path``; returns the number of its rows."""
        spark = rows.sparkSession
        try:
            done = spark.read.parquet(path)
        except Exception as e:  # only a table that isn't there yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            done = None
        self.embed(rows, done).write.mode("append").parquet(path)
        return spark.read.parquet(path).count()

    def run_stream(self, stream: DataFrame, path: str, checkpoint: str):
        """Starts a query that appends the embeddings of a stream (id, text) to a Parquet table."""

        def batch(df: DataFrame, number: int) -> None:
            self.embed(df).write.mode("overwrite").parquet(f"{path}/batch={number}")  # a repeated batch replaces itself

        return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def run_local(self, texts: list[str], ids: list[str] | None = None) -> list[list[float] | None]:
        """Embeds a list on the driver, ``concurrency`` batches at a time; batches whose ids are all done leave None.

        After the first error no further batch begins, and the last saved state stays.
        """
        ids = ids if ids is not None else [str(i) for i in range(len(texts))]
        if len(ids) != len(texts):
            raise ValidationError("there must be as many ids as texts")
        if len(set(ids)) != len(ids):
            raise ValidationError("ids must differ")
        state = (self.checkpoint.load() if self.checkpoint else None) or {}
        done = set(state.get("completed_ids", []))
        out: list[list[float] | None] = [None] * len(texts)
        parts = list(batches(range(len(texts)), self.batch_size))
        limiter = RateLimiter(self.requests_per_minute, self.tokens_per_minute)
        began, since, lock = time.monotonic(), 0, threading.Lock()
        todo = [p for p in parts if not all(ids[i] in done for i in p)]

        def task(part: list[int]) -> None:
            nonlocal since
            own = [texts[i] for i in part]
            with lock:
                limiter.wait(sum(map(len, own)))
            for i, v in zip(part, self.provider.embed(own).embeddings):
                out[i] = v
            with lock:
                done.update(ids[i] for i in part)
                since += 1
                if self.on_progress:
                    self.on_progress(Progress(len(parts) - len(todo) + since, len(parts), time.monotonic() - began))
                if self.checkpoint and since % self.checkpoint_interval == 0:
                    self._save(done)

        in_pool([functools.partial(task, p) for p in todo], self.concurrency)
        if self.checkpoint and since:
            self._save(done)
        return out

    def _save(self, done: set[str]) -> None:
        self.checkpoint.save({"completed_ids": sorted(done), "total": len(done), "at": time.time()})

