"""URL filters by a cascade of Bloom filters, exact over the corpus's keys and without a join.

Level 0 holds the listed keys; level 1 the unlisted keys of the corpus that level 0 wrongly accepts;
level 2 the listed keys that level 1 wrongly accepts, and so on until no error is left. Since the cascade
is built over the complete universe of keys, its answer for each of them is exact, in a few bits for each
listed key. Keys are spread over segments by hash; a segment's cascade is built by one task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodevec.llm.textbytes import mix
from lodevec.runtime import BROADCAST_BYTES, materialise, read_table

#: Keys of a segment, about; rows that one copy of a segment's cascade answers, about.
SEGMENT_KEYS, SEGMENT_ROWS = 200_000, 1_000_000
SALT = 0x51ED270B


def url_key(url: Column) -> Column:
    """The URL in lower case without scheme, fragment and trailing slashes."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(url), "^[a-z][a-z0-9+.-]*://", ""), "#.*$", ""), "/+$", "")


def host_key(url: Column) -> Column:
    """The host of the URL, in lower case."""
    return F.regexp_extract(url_key(url), "^([^/?:]+)", 1)


def hashes(key: Column) -> tuple[Column, Column]:
    """128 bits of hash of a key; two different keys of a corpus don't share them for any practical size."""
    return F.xxhash64(key), F.xxhash64(F.lit(SALT), key)


def _positions(h1: np.ndarray, h2: np.ndarray, level: int, n_hashes: int, n_bits: int) -> np.ndarray:
    base = mix(h1 + np.uint64(level * 0x9E3779B97F4A7C15 % 2**64))
    step = mix(h2 ^ np.uint64((level + 1) * 0xBF58476D1CE4E5B9 % 2**64)) | np.uint64(1)
    return mix(base[:, None] + np.arange(n_hashes, dtype=np.uint64)[None] * step[:, None]) % np.uint64(n_bits)


@dataclass
class Level:
    n_bits: int
    n_hashes: int
    bits: np.ndarray

    def has(self, h1: np.ndarray, h2: np.ndarray, level: int) -> np.ndarray:
        at = _positions(h1, h2, level, self.n_hashes, self.n_bits).astype(np.int64)
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).all(1)


def build(listed: tuple[np.ndarray, np.ndarray], rest: tuple[np.ndarray, np.ndarray]) -> list[Level]:
    """The levels for listed and unlisted keys, given as pairs of 64-bit hashes."""
    inside, outside, out = listed, rest, []
    while len(inside[0]):
        if len(out) == 100:
            raise ValueError("a listed and an unlisted key have the same 128-bit hash")
        n, other = len(inside[0]), max(1, len(outside[0]))
        rate = 0.5 if out else min(0.5, n * 0.5**0.5 / other)
        n_hashes = max(1, round(np.log2(1 / rate)))
        n_bits = max(8, int(np.ceil(n * n_hashes / np.log(2))))
        bits = np.zeros(n_bits // 8 + 1, np.uint8)
        at = _positions(*inside, len(out), n_hashes, n_bits).astype(np.int64).ravel()
        np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        level = Level(n_bits, n_hashes, bits)
        wrong = level.has(*outside, len(out))
        inside, outside = tuple(h[wrong] for h in outside), inside
        out.append(level)
    return out


def ask(levels: list[Level], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Whether each key is listed: the first level that lacks it decides."""
    answer, open_ = np.zeros(len(h1), bool), np.arange(len(h1))
    for i, level in enumerate(levels):
        has = level.has(h1[open_], h2[open_], i)
        answer[open_[~has]] = i % 2 == 1
        open_ = open_[has]
    if levels:
        answer[open_] = len(levels) % 2 == 1
    return answer


def _levels(table: pa.Table | pa.RecordBatch) -> list[Level]:
    """The levels of one segment in order."""
    found = sorted(zip(*(table.column(c).to_pylist() for c in ("level", "n_bits", "n_hashes", "bits"))))
    return [Level(m, k, np.frombuffer(b, np.uint8)) for _, m, k, b in found]


@dataclass
class Cascade:
    table: DataFrame
    segments: int
    size: int


def build_cascade(listed: DataFrame, universe: DataFrame) -> Cascade:
    """The cascade of the listed keys over the universe; both have a column ``key``.

    Null keys are ignored, repeated ones count once, and listed keys needn't be in the universe. With no
    listed key the cascade has no level and accepts nothing.
    """
    h1, h2 = hashes(F.col("key"))
    both = universe.select("key", F.lit(0).alias("listed")).unionByName(listed.select("key", F.lit(1).alias("listed"))).where("key is not null")
    both = materialise(both.select(h1.alias("h1"), h2.alias("h2"), "listed").groupBy("h1", "h2").agg(F.max("listed").alias("listed")), "url-keys")
    segments = max(1, -(-both.count() // SEGMENT_KEYS))

    def segment(key, rows):
        h = tuple(rows.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2"))
        on = rows.column("listed").to_numpy() == 1
        levels = build(tuple(x[on] for x in h), tuple(x[~on] for x in h))
        return pa.table({"segment": pa.array([key[0].as_py()] * len(levels), pa.int64()), "level": pa.array(range(len(levels)), pa.int32()), "n_bits": pa.array([x.n_bits for x in levels], pa.int64()), "n_hashes": pa.array([x.n_hashes for x in levels], pa.int32()), "bits": pa.array([x.bits.tobytes() for x in levels], pa.binary())})

    table = both.withColumn("segment", F.pmod("h1", F.lit(segments))).groupBy("segment").applyInArrow(segment, "segment bigint, level int, n_bits bigint, n_hashes int, bits binary")
    table = materialise(table, "cascade")
    return Cascade(table, segments, table.agg(F.coalesce(F.sum(F.length("bits")), F.lit(0))).first()[0])


def _asker(parts: dict[int, list[Level]], segments: int):
    """Whether keys, given by their hashes, are in a cascade, as a function of columns."""

    @F.arrow_udf("boolean")
    def listed(h1: pa.Array, h2: pa.Array) -> pa.Array:
        a, b = h1.to_numpy(zero_copy_only=False), h2.to_numpy(zero_copy_only=False).view(np.uint64)
        out, place = np.zeros(len(a), bool), a % segments
        for s in np.unique(place):
            if s in parts:
                own = np.flatnonzero(place == s)
                out[own] = ask(parts[s], a[own].view(np.uint64), b[own])
        return pa.array(out)

    return listed


def mark(rows: DataFrame, keys: dict[str, tuple[Column, Cascade]]) -> DataFrame:
    """``rows`` with a boolean column for each entry: whether its key is in its cascade. A null key isn't.

    The cascades travel with the function as long as they are small (their size is checked). Rows go to
    the segments of a larger one instead and are answered as they stream past: neither way has a join, and
    both give the same answers.
    """
    for name, (key, cascade) in keys.items():
        if cascade.size > BROADCAST_BYTES:
            rows = _mark_by_segment(rows, name, key, cascade)
            continue
        found = cascade.table.toArrow()
        at = np.array(found.column("segment").to_pylist(), np.int64)
        parts = {int(s): _levels(found.filter(pa.array(at == s))) for s in np.unique(at)}
        h1, h2 = hashes(key)
        rows = rows.withColumn(name, key.isNotNull() & _asker(parts, cascade.segments)(h1, h2))
    return rows


def _mark_by_segment(rows: DataFrame, name: str, key: Column, cascade: Cascade) -> DataFrame:
    """Rows are sent to the segment of their key, a hot segment's ones to several copies of it; the segment's levels come first."""
    h1, h2 = hashes(key)
    tagged = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), key.isNotNull().alias("named"), h1.alias("h1"), h2.alias("h2"))
    tagged = tagged.withColumn("segment", F.pmod("h1", F.lit(cascade.segments)))
    counts = {r.segment: r["count"] for r in tagged.groupBy("segment").count().collect()}
    ways = np.array([max(1, -(-counts.get(s, 0) // SEGMENT_ROWS)) for s in range(cascade.segments)], np.int64)
    first = np.cumsum(ways) - ways

    @F.arrow_udf("bigint")
    def group(segment: pa.Array, number: pa.Array) -> pa.Array:
        s = segment.to_numpy()
        return pa.array(first[s] + number.to_numpy() % ways[s])

    @F.arrow_udf("array<bigint>")
    def groups(segment: pa.Array) -> pa.Array:
        return pa.array([list(range(first[s], first[s] + ways[s])) for s in segment.to_pylist()], pa.list_(pa.int64()))

    kind = tagged.schema["row"].dataType.simpleString()
    own = tagged.select(group("segment", F.monotonically_increasing_id()).alias("at"), F.lit(1).alias("side"), "row", "named", "h1", "h2", *[F.lit(None).cast(t).alias(c) for c, t in (("level", "int"), ("n_bits", "bigint"), ("n_hashes", "int"), ("bits", "binary"))])
    levels = cascade.table.select(F.explode(groups("segment")).alias("at"), F.lit(0).alias("side"), F.lit(None).cast(kind).alias("row"), F.lit(False).alias("named"), F.lit(0).cast("bigint").alias("h1"), F.lit(0).cast("bigint").alias("h2"), "level", "n_bits", "n_hashes", "bits")
    parts = min(int(ways.sum()), 20_000)
    both = own.unionByName(levels).repartitionById(parts, F.pmod("at", F.lit(parts)).cast("int")).sortWithinPartitions("at", "side")

    def answer(batches):
        now, held = None, None
        for b in batches:
            at, side = b.column(0).to_numpy(), b.column(1).to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero((at[1:] != at[:-1]) | (side[1:] != side[:-1])) + 1, [len(at)]])
            for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if i == j:
                    continue
                if at[i] != now:
                    now, held = at[i], []
                part = b.slice(i, j - i)
                if side[i] == 0:
                    held += _levels(part)
                    continue
                on = ask(held, *(part.column(c).to_numpy().view(np.uint64) for c in (4, 5)))
                yield pa.RecordBatch.from_arrays([part.column(2), pa.array(on & part.column(3).to_numpy(zero_copy_only=False))], names=["row", "on"])

    return both.mapInArrow(answer, f"row {kind}, on boolean").select("row.*", F.col("on").alias(name))


def filter_pages(pages: DataFrame, listed_hosts: DataFrame, listed_urls: DataFrame, url: str = "url", key: str = "page_id") -> DataFrame:
    """One row for each page: page_id, url, host_listed, url_listed, blocked.

    ``listed_hosts`` and ``listed_urls`` have a column ``key``. The universe is all keys of the pages.
    A null or empty URL isn't listed. Repeated rows give repeated rows, an empty table gives an empty
    result, and other columns are neither read nor returned.
    """
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"))
    hosts, urls = host_key(F.col("url")), url_key(F.col("url"))
    by_host = build_cascade(listed_hosts, rows.select(hosts.alias("key")))
    by_url = build_cascade(listed_urls, rows.select(urls.alias("key")))
    out = mark(rows, {"host_listed": (hosts, by_host), "url_listed": (urls, by_url)})
    return out.withColumn("blocked", F.col("host_listed") | F.col("url_listed"))


def op4_url_filter(spark, sf_dir: str) -> DataFrame:
    """The tables hold no block list, so the listed keys are taken from the pages: mobile mirrors' hosts and tracked links."""
    pages = read_table(spark, sf_dir, "pages")
    hosts = pages.select(host_key(F.col("url")).alias("key")).where("key like 'm.%'")
    urls = pages.select(url_key(F.col("url")).alias("key")).where("key like '%utm_source=%'")
    return filter_pages(pages, hosts, urls)


_KEY = "regexp_replace(regexp_replace(regexp_replace(lower(url), '^[a-z][a-z0-9+.-]*://', ''), '#.*$', ''), '/+$', '')"
OP4_SQL = f"""
WITH k AS (SELECT page_id, url, {_KEY} AS u, regexp_extract({_KEY}, '^([^/?:]+)', 1) AS h FROM pages),
     hosts AS (SELECT DISTINCT h FROM k WHERE h LIKE 'm.%'),
     urls AS (SELECT DISTINCT u FROM k WHERE u LIKE '%utm_source=%')
SELECT page_id, url, coalesce(h IN (SELECT h FROM hosts), false) AS host_listed, coalesce(u IN (SELECT u FROM urls), false) AS url_listed,
       coalesce(h IN (SELECT h FROM hosts), false) OR coalesce(u IN (SELECT u FROM urls), false) AS blocked
FROM k"""
