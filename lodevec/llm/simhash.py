"""SimHash near-duplicates by the nearest-neighbour recursion of May and Ozerov.

Fingerprints are 256 sign bits of random projections of a text's word pairs. Close pairs are found
without comparing all: the coordinates are permuted and cut into strips of 32; a node of the recursion
draws random points of a strip and passes on the fingerprints whose partial distance to the point is
small; it recurses into the next strip until lists are short, and these are compared exhaustively. The
whole is repeated with new permutations until a pair at the radius is found with the target probability
(computed exactly, see ``plan``). Whether a fingerprint is in a list depends on it alone, so each row
finds all its lists without communication, and one shuffle brings the lists together. A list that stays
long, as those of many close fingerprints do, is cut into chunks, each pair of which is another task's work.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import comb, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodevec.llm.textbytes import Hasher, lower, mix, runs, spans
from lodevec.plans.components import connected_components
from lodevec.runtime import broadcast_if_small, materialise, read_table

BITS, STRIP = 256, 32
WORDS = BITS // 64
#: Pairs at this Hamming distance or less are near duplicates (a cosine of about 0.77).
RADIUS = 56
TARGET_RECALL = 0.92
#: Lists of about so many fingerprints are compared exhaustively.
LIST_SIZE = 2000
#: A list of more fingerprints is compared by pairs of chunks of about so many.
CHUNK = 16_384
SKETCH = 2048
SEED = 20240229
FP = [f"f{i}" for i in range(WORDS)]


def _signs() -> np.ndarray:
    return np.random.default_rng(SEED).choice(np.array([-1, 1], np.float32), (SKETCH, BITS))


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``spans`` of words, cut around each character of three bytes from U+3000 to U+DFFF."""
    start, end, owner = spans(data, offsets)
    lead = np.flatnonzero((data >= 0xE3) & (data <= 0xED))
    if not len(lead):
        return start, end, owner
    inside = np.zeros(len(data) + 1, bool)
    inside[start] = True
    inside[lead] = True
    inside[lead + 3] = True
    kept = np.zeros(len(data) + 1, np.int64)
    kept[start] += 1
    kept[end] -= 1
    word = np.cumsum(kept) > 0
    cut = np.flatnonzero(inside & word)
    stop = np.append(cut[1:], len(data))
    last = end[np.searchsorted(end, cut, side="right")]
    return cut, np.minimum(stop, last), np.searchsorted(offsets, cut, side="right") - 1


def fingerprints_of(texts: pa.Array, signs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprints as rows of uint64, whether the text has words). Case and punctuation don't count.

    Word pairs (the single word of a one-word text) are summed into a signed count sketch, damped by a
    square root so that much repeated pairs don't rule, and projected by random signs. A character of a
    script that is written without spaces (Chinese, Japanese, Korean) is a word of its own.
    """
    out, has = np.zeros((len(texts), WORDS), np.uint64), np.zeros(len(texts), bool)
    for i, j, data, offsets in runs(lower(texts)):
        start, end, owner = _words(data, offsets)
        if not len(start):
            continue
        word = Hasher(data)(start, end, 3)
        pair = np.flatnonzero(owner[1:] == owner[:-1])
        single = np.flatnonzero(np.bincount(owner, minlength=j - i)[owner] == 1)
        h = np.concatenate([mix(word[pair] * np.uint64(0x9FB21C651E98DF25) + word[pair + 1]), word[single]])
        of = np.concatenate([owner[pair], owner[single]])
        place = of * SKETCH + (h & np.uint64(SKETCH - 1)).astype(np.int64)
        sketch = np.bincount(place, weights=np.where(h >> np.uint64(63), 1.0, -1.0), minlength=(j - i) * SKETCH).reshape(j - i, SKETCH)
        sketch = (np.sign(sketch) * np.sqrt(np.abs(sketch))).astype(np.float32)
        out[i:j] = np.packbits(sketch @ signs > 0, axis=1, bitorder="little").view(np.uint64)
        has[i:j] = np.bincount(owner, minlength=j - i) > 0
    return out, has


def unit(text: Column, key: Column) -> list[Column]:
    """128 bits of hash of a row's key and text: rows that share them are copies of one another."""
    return [F.xxhash64(key, text).alias("u0"), F.xxhash64(F.lit(SEED), text, key).alias("u1")]


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(row, doc_id, u0, u1, f0..f3) of the rows that have at least one word: a number and hashes of their own, and the fingerprint."""
    texts = F.col(text).cast("string")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("doc_id"), *unit(texts, F.col(key)), texts.alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def sign(batches):
        signs = _signs()
        for b in batches:
            fp, has = fingerprints_of(b.column(4), signs)
            at = pa.array(np.flatnonzero(has))
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in range(4)), *(pa.array(fp[has, k].view(np.int64)) for k in range(WORDS))], names=["row", "doc_id", "u0", "u1", *FP])

    return rows.where("text is not null").mapInArrow(sign, f"row bigint, doc_id {kind}, u0 bigint, u1 bigint, " + ", ".join(f"{x} bigint" for x in FP))


@dataclass(frozen=True)
class Level:
    radius: int
    points: int


@dataclass(frozen=True)
class Recursion:
    levels: tuple[Level, ...]
    repeats: int
    recall: float


def _at_most(n: int, k: int) -> float:
    return sum(comb(n, i) for i in range(k + 1)) / 2**n


def _both(within: int, distance: int) -> float:
    """Chance that both of two fingerprints at ``distance`` are within ``within`` of a random point of a strip."""
    total = 0.0
    for apart in range(min(STRIP, distance) + 1):
        share = comb(distance, apart) * comb(BITS - distance, STRIP - apart) / comb(BITS, STRIP)
        same = STRIP - apart
        ok = sum(comb(same, a) * comb(apart, b) for a in range(same + 1) for b in range(apart + 1) if a + b <= within and a + apart - b <= within)
        total += share * ok / 2**STRIP
    return total


def plan(n: int, radius: int = RADIUS, list_size: int = LIST_SIZE, recall: float = TARGET_RECALL) -> Recursion:
    """Depth, partial radii, points and repeats for n fingerprints: the same rule at every size.

    A level passes at most about a sixteenth of a list (the radius of its ball is chosen for that) and
    has as many points as make each fingerprint pass once on average. The chance that a pair at the
    radius ends in a common list follows by recursion, and sets the repeats.
    """
    goal, levels, passed = min(1.0, list_size / max(n, 1)), [], 1.0
    depth = max(1, round(log(1 / goal) / log(16))) if goal < 1 else 0
    for left in range(min(depth, BITS // STRIP), 0, -1):
        want = (goal / passed) ** (1 / left)
        within = min(range(STRIP + 1), key=lambda k: abs(log(_at_most(STRIP, k)) - log(want)))
        p = _at_most(STRIP, within)
        levels.append(Level(within, max(1, round(1 / p))))
        passed *= p
    found = 1.0
    for level in reversed(levels):
        found = 1 - (1 - _both(level.radius, radius) * found) ** level.points
    repeats = 1 if found >= recall else int(np.ceil(log(1 - recall) / log(1 - found)))
    return Recursion(tuple(levels), repeats, 1 - (1 - found) ** repeats)


def lists_of(fp: np.ndarray, rec: Recursion, repeat: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) memberships of one repeat: the recursion's leaves that a fingerprint reaches."""
    rng = np.random.default_rng([SEED, repeat])
    bits = np.unpackbits(np.ascontiguousarray(fp).view(np.uint8), axis=1, bitorder="little")[:, rng.permutation(BITS)]
    strips = np.ascontiguousarray(np.packbits(bits, axis=1, bitorder="little")).view(np.uint32)
    row, node = np.arange(len(fp)), np.zeros(len(fp), np.int64)
    width = 1
    for depth, level in enumerate(rec.levels):
        points = rng.integers(0, 1 << STRIP, (width, level.points), dtype=np.uint32)
        near = np.bitwise_count(strips[row, depth][:, None] ^ points[node]) <= level.radius
        at, which = np.nonzero(near)
        row, node, width = row[at], node[at] * level.points + which, width * level.points
    return row, node


def close_pairs(fp: np.ndarray, radius: int, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """All i < j of a list within the radius, exhaustively; half of the bits rule most pairs out."""
    left, right = [], []
    for i in range(0, len(fp), block):
        a = fp[i : i + block]
        d = np.bitwise_count(a[:, None, 0] ^ fp[None, i:, 0]) + np.bitwise_count(a[:, None, 1] ^ fp[None, i:, 1])
        x, y = np.nonzero(d <= radius)
        x, y = x[y > x], y[y > x]
        rest = d[x, y].astype(np.int64)
        for k in range(2, WORDS):
            rest += np.bitwise_count(a[x, k] ^ fp[i + y, k])
        left.append(i + x[rest <= radius])
        right.append(i + y[rest <= radius])
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64),) * 2


def links(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """The least member of each of n rows' component under the pairs."""
    label = np.arange(n)
    while True:
        old = label.copy()
        np.minimum.at(label, y, label[x])
        np.minimum.at(label, x, label[y])
        label = label[label]
        if (old == label).all():
            return label


def long_lists(rows: DataFrame, rec: Recursion, chunk: int = CHUNK) -> dict[int, int]:
    """The number of chunks of each list that is longer than one; there are at most fingerprints * repeats / chunk."""

    def tally(batches):
        found: dict[int, int] = {}
        for b in batches:
            for _, _, _, lists in _memberships(b, rec):
                own, n = np.unique(lists, return_counts=True)
                for x, c in zip(own.tolist(), n.tolist()):
                    found[x] = found.get(x, 0) + c
            if len(found) > 1 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], names=["list", "n"])
                found = {}
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], names=["list", "n"])

    long_ = rows.mapInArrow(tally, "list bigint, n bigint").groupBy("list").agg(F.sum("n").alias("n")).where(F.col("n") > chunk)
    return {r["list"]: -(-r.n // chunk) for r in long_.collect()}


def _memberships(batch: pa.RecordBatch, rec: Recursion):
    """(fids, fingerprints, rows, lists) of parts of a batch and of each repeat."""
    for i in range(0, len(batch), 4096):
        part = batch.slice(i, 4096)
        fp = np.stack([part.column(k + 1).to_numpy() for k in range(WORDS)], axis=1).view(np.uint64)
        for r in range(rec.repeats):
            row, node = lists_of(fp, rec, r)
            yield part.column(0).to_numpy(), fp, row, node + (np.int64(r) << np.int64(48))


def near_edges(unique: DataFrame, n: int, radius: int = RADIUS, recall: float = TARGET_RECALL, chunk: int = CHUNK) -> DataFrame:
    """(a, b) edges, a < b, that join the fids of distinct fingerprints which the recursion finds close.

    Within a list the close pairs are replaced by a spanning forest of them, which has the same
    components: nothing is dropped, however many copies a list holds. A list of more than ``chunk``
    fingerprints is dealt out to chunks by their fids, and each pair of chunks (a chunk with itself
    included) is compared by itself, so that the work of no task grows with a list.
    """
    rec = plan(n, radius, recall=recall)
    cores = unique.sparkSession.sparkContext.defaultParallelism
    rows = unique.select("fid", *FP).repartition(max(cores, n // 50_000))
    long_ = long_lists(rows, rec, chunk) if n > chunk else {}
    long_keys = np.array(sorted(long_), np.int64)
    long_ways = np.array([long_[x] for x in long_keys.tolist()], np.int64)

    def spread(batches):
        for b in batches:
            for fid, fp, row, lists in _memberships(b, rec):
                pair = np.zeros(len(row), np.int64)
                side = np.zeros(len(row), np.int8)
                if len(long_keys):
                    at = np.minimum(np.searchsorted(long_keys, lists), len(long_keys) - 1)
                    ways = np.where(long_keys[at] == lists, long_ways[at], 1)
                    own = (mix(fid[row].view(np.uint64)) >> np.uint64(1)).astype(np.int64) % ways
                    copies = np.where(ways > 1, ways, 1)
                    last = np.cumsum(copies)
                    again = np.repeat(np.arange(len(row)), copies)
                    other = np.arange(len(again)) - (last - copies)[again]
                    row, lists, own, ways = row[again], lists[again], own[again], ways[again]
                    pair = np.minimum(own, other) * ways + np.maximum(own, other)
                    side = np.where(own == other, 0, np.where(own < other, 1, 2)).astype(np.int8)
                yield pa.RecordBatch.from_arrays([pa.array(lists), pa.array(pair), pa.array(side), pa.array(fid[row]), *(pa.array(fp[row, k].view(np.int64)) for k in range(WORDS))], names=["list", "pair", "side", "fid", *FP])

    def compare(batches):
        def edges(parts):
            fid, fp, side = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(fid, kind="stable")
            fid, fp, side = fid[order], fp[order], side[order]
            x, y = close_pairs(fp, radius) if not side[0] else close_across(fp, side == 1, radius)
            if not len(x):
                return None
            label = links(x, y, len(fid))
            at = np.flatnonzero(label != np.arange(len(fid)))
            return pa.RecordBatch.from_arrays([pa.array(fid[label[at]]), pa.array(fid[at])], names=["a", "b"])

        open_list, parts = None, []
        for b in batches:
            if not len(b):
                continue
            lists, pair, side, fid = (b.column(c).to_numpy() for c in range(4))
            fp = np.stack([b.column(k + 4).to_numpy() for k in range(WORDS)], axis=1).view(np.uint64)
            cuts = np.concatenate([[0], np.flatnonzero((lists[1:] != lists[:-1]) | (pair[1:] != pair[:-1])) + 1, [len(lists)]])
            for s, e in zip(cuts[:-1], cuts[1:]):
                if parts and (lists[s], pair[s]) != open_list:
                    if sum(len(p[0]) for p in parts) > 1 and (out := edges(parts)) is not None:
                        yield out
                    parts = []
                open_list = (lists[s], pair[s])
                parts.append((fid[s:e], fp[s:e], side[s:e]))
        if parts and sum(len(p[0]) for p in parts) > 1 and (out := edges(parts)) is not None:
            yield out

    kinds = ", ".join(f"{x} bigint" for x in FP)
    lists = rows.mapInArrow(spread, f"list bigint, pair bigint, side byte, fid bigint, {kinds}")
    lists = lists.repartition(max(3 * cores, n * rec.repeats // 200_000), "list", "pair").sortWithinPartitions("list", "pair")
    return lists.mapInArrow(compare, "a bigint, b bigint").distinct()


def close_across(fp: np.ndarray, first: np.ndarray, radius: int, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of one fingerprint of the first chunk and one of the other within the radius."""
    left, right, a_rows, b_rows = [], [], np.flatnonzero(first), np.flatnonzero(~first)
    other = fp[b_rows]
    for i in range(0, len(a_rows), block):
        a = fp[a_rows[i : i + block]]
        d = np.bitwise_count(a[:, None, 0] ^ other[None, :, 0]) + np.bitwise_count(a[:, None, 1] ^ other[None, :, 1])
        x, y = np.nonzero(d <= radius)
        rest = d[x, y].astype(np.int64)
        for k in range(2, WORDS):
            rest += np.bitwise_count(a[x, k] ^ other[y, k])
        left.append(a_rows[i + x[rest <= radius]])
        right.append(b_rows[y[rest <= radius]])
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64),) * 2


def _groups(own: DataFrame, radius: int, recall: float) -> DataFrame:
    """(doc_id, u0, u1, first, kept): the rows of groups, whether a row is the one that stays, and that one's key and hashes.

    The row of the least key stays, null keys last, then the first as they are numbered.
    """
    unique = materialise(own.groupBy(*FP).agg(F.min("row").alias("fid")), "distinct-fingerprints")
    edges = materialise(near_edges(unique, unique.count(), radius, recall), "near-edges")
    roots = connected_components(edges)
    named = unique.join(roots.withColumnRenamed("node", "fid"), "fid", "left").select(*FP, F.coalesce("component", "fid").alias("root"))
    found = materialise(own.join(named, FP).select("row", "doc_id", "u0", "u1", "root"), "rooted")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row", "u0", "u1"))
    keepers = found.groupBy("root").agg(least.alias("kept"), F.count("*").alias("n")).where("n > 1")
    return found.join(keepers, "root").select("doc_id", "u0", "u1", (F.col("row") == F.col("kept.row")).alias("first"), "kept")


def duplicates(docs: DataFrame, radius: int = RADIUS, recall: float = TARGET_RECALL, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, duplicate_of): every row that repeats another one, and the key of the row of its group that stays.

    Groups are the connected components of rows with equal or close fingerprints; of each the row with the
    least key stays (a null key comes last; of equal keys one row stays). Keys may be of any type that can
    be ordered, keep it, and needn't be there or differ: rows are told apart by a number of their own.
    Texts whose words are the same but for case and punctuation are equal, and whole texts count, however
    long. Null, empty and wordless texts are in no group. An empty table gives an empty result; other
    columns, of any name, are neither read nor returned.
    """
    own = materialise(fingerprints(docs, text, key), "fingerprints")
    return _groups(own, radius, recall).where("not first").select("doc_id", F.col("kept.doc_id").alias("duplicate_of"))


def drop_duplicates(docs: DataFrame, radius: int = RADIUS, text: str = "text", key: str = "doc_id", recall: float = TARGET_RECALL) -> DataFrame:
    """The rows without those that ``duplicates`` finds, with all their columns: one of each group stays.

    Rows go by the hashes of their key and text, so that rows which share a key but not a text are judged by
    themselves, and no copy of the documents is written; of rows that share both one stays. The hashes to
    drop are broadcast only if they are few by count; beyond that the join is a shuffled one.
    """
    own = materialise(fingerprints(docs, text, key), "fingerprints")
    others = _groups(own, radius, recall).where("not first")
    same = (F.col("u0") == F.col("kept.u0")) & (F.col("u1") == F.col("kept.u1"))
    goes = materialise(others.select("u0", "u1", same.alias("same")).distinct(), "dropped")
    counts = {r.same: r["count"] for r in goes.groupBy("same").count().collect()}
    hashes = unit(F.col(text).cast("string"), F.col(key))

    def side(which: bool) -> tuple[DataFrame, Column]:
        part = goes.where(F.col("same") == which).select(F.col("u0").alias("__u0"), F.col("u1").alias("__u1"))
        return broadcast_if_small(part, counts.get(which, 0), 32), (hashes[0] == F.col("__u0")) & (hashes[1] == F.col("__u1"))

    kept = docs.join(*side(False), "left_anti")
    if not counts.get(True):
        return kept
    repeated = kept.join(*side(True), "left_semi")
    names = [f"__unit{k}{'_' * max(map(len, docs.columns))}" for k in (0, 1)]
    once = repeated.withColumns(dict(zip(names, hashes))).dropDuplicates(names).drop(*names)
    return kept.join(*side(True), "left_anti").unionByName(once)


def op5_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return duplicates(read_table(spark, sf_dir, "documents"))
