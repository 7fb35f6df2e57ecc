"""Pairwise scores by tiles: vectors are packed into matrices, and a tile compares two strips of them.

A block is one row (block, ids, flat matrix) of up to 256 vectors. Each side's blocks are dealt to strips, and
every pair of strips is a tile, which is one task's or a part of it: a block is copied to the tiles of its
strip alone, so that a table is shuffled once for each strip of the other side rather than once for each
block. A task holds the left strip of one tile, which is bounded in bytes, and one block of the right strip.
A table that is compared with itself is packed once, and only tiles on or above the diagonal are made.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodevec.errors import ValidationError
from lodevec.runtime import materialise

#: Vectors of a block, at most.
BLOCK_ROWS = 256
#: Vectors and bytes of the left strip of a tile, about; vectors of the right one.
STRIP_ROWS, STRIP_BYTES, RIGHT_ROWS = 32_768, 32 << 20, 262_144
#: Blocks of the left strip are joined to so many vectors.
HELD_ROWS = 2048
#: Partitions of a shuffle of tiles, at most; a partition takes its tiles one after another.
MOST_PARTS = 20_000

Work = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bool], "tuple | None"]


@dataclass(frozen=True)
class Blocks:
    """A packed table (block, strip, n, ids, flat), its rows and blocks and the length of its vectors."""

    table: DataFrame
    rows: int
    count: int
    dim: int


def packed(df: DataFrame, key: str, vector: str, rows: int | None = None) -> Blocks:
    """Blocks of the rows with a key and a vector; null keys and vectors are left out. The table is read once."""
    good = df.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    size = rows or BLOCK_ROWS

    def pack(batches):
        part, number = TaskContext.get().partitionId(), 0
        for b in batches:
            for i in range(0, len(b), size):
                own = b.slice(i, size)
                n, flat = len(own), own.column(1).flatten()
                lists = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
                lengths = np.diff(np.asarray(own.column(1).offsets)[: n + 1])
                if (lengths != lengths[0]).any():
                    raise ValidationError("vectors differ in length")
                yield pa.RecordBatch.from_arrays([pa.array([(part << 32) + number]), pa.array([part + number]), pa.array([n], pa.int32()), pa.array([int(lengths[0])], pa.int32()), lists(own.column(0)), lists(flat)], names=["block", "strip", "n", "dim", "ids", "flat"])
                number += 1

    table = materialise(good.mapInArrow(pack, "block bigint, strip bigint, n int, dim int, ids array<bigint>, flat array<double>"), "blocks")
    found = table.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("*").alias("count"), F.coalesce(F.min("dim"), F.lit(0)).alias("least"), F.coalesce(F.max("dim"), F.lit(0)).alias("dim")).first()
    if found.least != found.dim:
        raise ValidationError("vectors differ in length")
    return Blocks(table.drop("dim"), found.rows, found["count"], found.dim)


def matrix(flat: pa.Scalar, n: int) -> np.ndarray:
    values = flat.values.to_numpy(zero_copy_only=False)
    if len(values) % n:
        raise ValidationError("vectors differ in length")
    return values.reshape(n, -1)


def scores(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Similarities of all rows of a to all rows of b."""
    if a.shape[1] != b.shape[1]:
        raise ValueError("vectors differ in length")
    if metric == "manhattan":
        return 1 / (1 + np.stack([np.abs(b - x).sum(1) for x in a]))
    product = a @ b.T
    if metric == "dot":
        return product
    if metric == "cosine":
        norms = np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None]
        return np.divide(product, norms, out=np.zeros_like(product), where=norms != 0)
    square = np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * product, 0)
    return 1 / (1 + np.sqrt(square))


def grid(left: Blocks, right: Blocks, cores: int, symmetric: bool) -> tuple[int, int]:
    """Strips of the left and of the right side: as few as memory allows, but enough to keep the cores busy."""
    most = max(BLOCK_ROWS, min(STRIP_ROWS, STRIP_BYTES // (8 * max(1, left.dim))))
    a, b = max(1, -(-left.rows // most)), max(1, -(-right.rows // RIGHT_ROWS))
    if symmetric:
        a = max(a, min(left.count, int(np.ceil(np.sqrt(4 * cores)))))
        return max(1, a), max(1, a)
    b = max(b, min(right.count, -(-2 * cores // a)))
    a = max(a, min(left.count, -(-2 * cores // b)))
    return max(1, a), max(1, b)


def _tiles(left: Blocks, right: Blocks, symmetric: bool) -> DataFrame:
    """(tile, diagonal, side, block, ids, flat), each tile in one partition, its left strip first."""
    spark = left.table.sparkSession
    a, b = grid(left, right, spark.sparkContext.defaultParallelism, symmetric)
    s, t = F.pmod("strip", F.lit(a)), F.pmod("strip", F.lit(b))
    if symmetric:
        number = lambda i, j: i * a - (i * (i - 1) / 2).cast("bigint") + j - i
        total = a * (a + 1) // 2
        of_left = F.transform(F.sequence(s, F.lit(a - 1).cast("bigint")), lambda j: F.struct(number(s, j).alias("tile"), (s == j).alias("diagonal")))
        of_right = F.transform(F.sequence(F.lit(0).cast("bigint"), t), lambda i: F.struct(number(i, t).alias("tile"), (i == t).alias("diagonal")))
    else:
        total = a * b
        of_left = F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(b - 1).cast("bigint")), lambda j: F.struct((s * b + j).alias("tile"), F.lit(False).alias("diagonal")))
        of_right = F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(a - 1).cast("bigint")), lambda i: F.struct((i * b + t).alias("tile"), F.lit(False).alias("diagonal")))
    sides = [x.table.select(F.inline(at), F.lit(k).alias("side"), "block", "ids", "flat") for k, (x, at) in enumerate(((left, of_left), (right, of_right)))]
    parts = min(total, MOST_PARTS)
    return sides[0].unionByName(sides[1]).repartitionById(parts, F.pmod("tile", F.lit(parts)).cast("int")).sortWithinPartitions("tile", "side")


def _blocks(batches) -> Iterator[tuple]:
    for b in batches:
        tile, diagonal, side, block = (b.column(c).to_pylist() for c in range(4))
        for i in range(len(b)):
            ids = b.column(4)[i].values.to_numpy(zero_copy_only=False)
            yield tile[i], diagonal[i], side[i], block[i], ids, matrix(b.column(5)[i], len(ids))


def _joined(held: list[tuple]) -> list[tuple]:
    out, part, n = [], [], 0
    for x in held:
        part.append(x)
        n += len(x[1])
        if n >= HELD_ROWS:
            out.append((part[0][0], np.concatenate([p[1] for p in part]), np.concatenate([p[2] for p in part])))
            part, n = [], 0
    if part:
        out.append((part[0][0], np.concatenate([p[1] for p in part]), np.concatenate([p[2] for p in part])))
    return out


def per_pair(left: Blocks, right: Blocks | None, work: Work, schema: str, names: list[str]) -> DataFrame:
    """Rows that ``work(ids, matrix, ids, matrix, same)`` makes of pairs of blocks; ``work`` returns columns or None.

    Without ``right`` the left side is compared with itself, each unordered pair of blocks once; ``same``
    tells that both are one block. Otherwise ``same`` is false.
    """

    def run(batches):
        tile, held, ready = None, [], False
        for at, diagonal, side, block, ids, m in _blocks(batches):
            if at != tile:
                tile, held, ready = at, [], False
            if side == 0:
                held.append((block, ids, m))
                continue
            if not ready:
                held, ready = held if diagonal else _joined(held), True
            for number, a_ids, a in held:
                if diagonal and number > block:
                    continue
                out = work(a_ids, a, ids, m, diagonal and number == block)
                if out is not None and len(out[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=names)

    return _tiles(left, right or left, right is None).mapInArrow(run, schema)


def per_tile(own: Blocks, work: Work, schema: str, names: list[str]) -> DataFrame:
    """Rows that ``work(ids, matrix, ids, matrix, same)`` makes of whole tiles of a table with itself, both strips in memory.

    Each unordered pair of strips is given once; ``same`` tells that both are one strip.
    """

    def run(batches):
        def done():
            if sides[0]:
                one, two = ((np.concatenate([x for x, _ in s]), np.concatenate([m for _, m in s])) if s else (None, None) for s in sides)
                out = work(*one, *(one if same else two), same) if same or sides[1] else None
                if out is not None and len(out[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=names)

        tile, same, sides = None, False, ([], [])
        for at, diagonal, side, _, ids, m in _blocks(batches):
            if at != tile:
                yield from done()
                tile, same, sides = at, diagonal, ([], [])
            if not (diagonal and side):
                sides[side].append((ids, m))
        yield from done()

    return _tiles(own, own, True).mapInArrow(run, schema)


def best_of(left: Blocks, right: Blocks, score: Callable[[np.ndarray, np.ndarray], np.ndarray], k: int, others: bool = False) -> DataFrame:
    """(query_id, id, score): of each left row the k right rows of the greatest scores in every tile.

    Scores are compared when rounded to 9 digits, NaN last, then ids. ``others``: a row isn't compared with its own id.
    A tile gives k rows a query, however long its right strip is.
    """

    def run(batches):
        def done():
            for (_, a_ids, _), (row, hit, s, _) in zip(held, state):
                if len(row):
                    yield pa.RecordBatch.from_arrays([pa.array(a_ids[row]), pa.array(hit), pa.array(s)], names=["query_id", "id", "score"])

        tile, held, ready, state, least = None, [], False, [], []
        for at, _, side, block, ids, m in _blocks(batches):
            if at != tile:
                yield from done()
                tile, held, ready, state, least = at, [], False, [], []
            if side == 0:
                held.append((block, ids, m))
                continue
            if not ready:
                held, ready = _joined(held), True
                state = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)) for _ in held]
                least = [np.full(len(a_ids), -np.inf) for _, a_ids, _ in held]
            for i, (_, a_ids, a) in enumerate(held):
                s = np.asarray(score(a, m), float)
                order = np.where(np.isnan(s), -np.inf, s)
                mask = order >= least[i][:, None] - 1e-8
                if len(ids) > k and not len(state[i][0]):
                    mask &= order >= np.partition(order, len(ids) - k, axis=1)[:, len(ids) - k][:, None] - 1e-8
                if others:
                    mask &= a_ids[:, None] != ids[None]
                row, col = np.nonzero(mask)
                if not len(row):
                    continue
                new = (row, ids[col], s[row, col], np.round(order[row, col], 9))
                row, hit, s, rank = (np.concatenate(x) for x in zip(state[i], new))
                by = np.lexsort((hit, -rank, row))
                first = np.searchsorted(row[by], np.arange(len(a_ids)))
                place = np.arange(len(by)) - first[row[by]]
                by = by[place < k]
                state[i] = row[by], hit[by], s[by], rank[by]
                last = by[place[place < k] == k - 1]
                least[i][row[last]] = rank[last]
        yield from done()

    return _tiles(left, right, False).mapInArrow(run, "query_id bigint, id bigint, score double")
