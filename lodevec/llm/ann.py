"""k nearest neighbours by stable projections and a kd-tree (the SRS scheme).

Vectors are projected by a Gaussian (2-stable) matrix to a few dimensions, where the squared distance of
two points is their true squared distance times a chi-square variable. A kd-tree indexes the projections;
a query takes leaves by increasing projected distance, computes true distances, and stops when the next
leaf is so far that a still unseen point nearer than its k-th best would have had a projection that short
with probability ``confidence`` at least: ``chi2_cdf(next^2 / kth^2) >= confidence``.

The upper levels of the tree are fitted on a bounded sample of projections and cut the table into cells; a
cell of too many rows (equal vectors can't be cut) is dealt out to pieces. Every row is in a piece. A query
first searches its own piece, whose k-th distance bounds the answer. Queries of near cells then make up
strips that a task holds in memory, and the pieces that a strip's queries can't exclude by the same test
stream past it: a piece is shuffled once for each strip that needs it, and not once for each query.
"""

from __future__ import annotations

from math import exp, lgamma, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodevec.runtime import BROADCAST_BYTES, materialise, read_table

DIMENSIONS = 16
CONFIDENCE = 0.95
NEIGHBOURS = 10
#: Rows of a cell of the upper tree, and of a leaf of the lower one; queries of a strip.
CELL_ROWS, LEAF_ROWS, STRIP_QUERIES = 8192, 128, 65_536
#: Rows whose projections the upper tree is fitted on, about, and rows of the sample that a cell has at least.
SAMPLE_ROWS, SAMPLE_OF_CELL = 262_144, 32
#: Elements of the arrays of gaps between queries and boxes, about.
GAPS = 1 << 22
SEED = 7


def chi2_cdf(x: float, k: int) -> float:
    """Distribution function of chi-square with k degrees of freedom, by the series of the incomplete gamma."""
    if x <= 0:
        return 0.0
    a, h = k / 2, x / 2
    term = total = 1 / a
    n = 0
    while term > total * 1e-15 and n < 10_000:
        n += 1
        term *= h / (a + n)
        total += term
    return min(1.0, total * exp(-h + a * log(h) - lgamma(a)))


def chi2_quantile(p: float, k: int) -> float:
    low, high = 0.0, 1.0
    while chi2_cdf(high, k) < p:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < p else (low, mid)
    return high


def projection(dim: int, m: int = DIMENSIONS) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((dim, m))


def kd_leaves(y: np.ndarray, leaf: int = LEAF_ROWS) -> list[np.ndarray]:
    """Row numbers of the leaves of a kd-tree that is cut at medians of the widest dimension."""
    out, stack = [], [np.arange(len(y))]
    while stack:
        rows = stack.pop()
        if len(rows) <= leaf:
            out.append(rows)
            continue
        dim = int(np.ptp(y[rows], axis=0).argmax())
        half = len(rows) // 2
        rows = rows[np.argpartition(y[rows, dim], half)]
        stack += [rows[half:], rows[:half]]
    return out


def box_distance(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of queries to boxes; some queries at a time, so that memory doesn't grow with both."""
    out = np.empty((len(q), len(low)))
    step = max(1, GAPS // max(1, low.size))
    for i in range(0, len(q), step):
        part = q[i : i + step, None]
        gap = np.maximum(np.maximum(low[None] - part, part - high[None]), 0)
        out[i : i + step] = np.einsum("qbm,qbm->qb", gap, gap)
    return out


class UpperTree:
    """Cells of a complete kd-tree that is cut at medians of the widest dimension of a sample; nodes are numbered as in a heap."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth = depth
        self.dim, self.cut = np.zeros(1 << depth, np.int64), np.full(1 << depth, np.inf)
        stack = [(1, np.arange(len(sample)))] if depth and len(sample) else []
        while stack:
            node, rows = stack.pop()
            dim = int(np.ptp(sample[rows], axis=0).argmax())
            self.dim[node], self.cut[node] = dim, np.median(sample[rows, dim])
            above = sample[rows, dim] > self.cut[node]
            if 2 * node < len(self.dim):
                stack += [(2 * node + side, part) for side, part in ((0, rows[~above]), (1, rows[above])) if len(part)]

    def cells(self, y: np.ndarray) -> np.ndarray:
        node = np.ones(len(y), np.int64)
        for _ in range(self.depth):
            node = 2 * node + (y[np.arange(len(y)), self.dim[node]] > self.cut[node])
        return node - (1 << self.depth)


def search(q_id, q, q_y, p_id, p, p_y, k: int, bound: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers into p, squared distances), k a query, -1 and inf where there are fewer.

    ``bound``: squared distances beyond which nothing is wanted; ``limit``: the chi-square quantile. A
    point isn't its own neighbour. Queries of a kd-leaf go together, and take the leaves of the points
    by increasing projected distance until each of them may stop.
    """
    leaves = kd_leaves(p_y)
    low, high = np.stack([p_y[r].min(0) for r in leaves]), np.stack([p_y[r].max(0) for r in leaves])
    norm = np.einsum("ij,ij->i", p, p)
    found, dist = np.full((len(q), k), -1), np.full((len(q), k), np.inf)
    for rows in kd_leaves(q_y):
        gaps = box_distance(q_y[rows], low, high)
        order = np.argsort(gaps.min(0), kind="stable")
        ahead = np.minimum.accumulate(gaps[:, order][:, ::-1], axis=1)[:, ::-1]  # the least gap still to come
        own, q_norm = q[rows], np.einsum("ij,ij->i", q[rows], q[rows])
        at, ds = np.full((len(rows), k), -1), np.full((len(rows), k), np.inf)
        for r in range(0, len(order), 4):
            live = np.flatnonzero(ahead[:, r] < limit * np.minimum(ds[:, -1], bound[rows]))
            if not len(live):
                break
            cand = np.concatenate([leaves[x] for x in order[r : r + 4]])
            d = np.maximum(q_norm[live, None] + norm[cand][None] - 2 * (own[live] @ p[cand].T), 0)
            d[q_id[rows[live]][:, None] == p_id[cand][None]] = np.inf
            d = np.concatenate([ds[live], d], axis=1)
            who = np.concatenate([at[live], np.broadcast_to(cand, (len(live), len(cand)))], axis=1)
            best = np.argpartition(d, k - 1, axis=1)[:, :k]
            d, who = np.take_along_axis(d, best, 1), np.take_along_axis(who, best, 1)
            best = np.argsort(d, axis=1, kind="stable")
            ds[live], at[live] = np.take_along_axis(d, best, 1), np.take_along_axis(who, best, 1)
        found[rows], dist[rows] = np.where(np.isfinite(ds), at, -1), ds
    return found, dist


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(column), -1)


def _lists(values: np.ndarray, sizes) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values))


def _usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    kind = vectors.schema[vector].dataType
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    rows = vectors.select(F.col(key).alias("key"), F.col(vector).cast("array<float>" if single else "array<double>").alias("v"), F.col("__asks").alias("asks"))
    rows = rows.where(F.col("key").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
    return rows.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))


_BLOCK = "kind int, piece int, strip int, ids array<bigint>, v array<double>, y array<double>, bound array<double>, visits array<int>, hits array<bigint>, far array<double>"


def knn(vectors: DataFrame, k: int = NEIGHBOURS, dimensions: int = DIMENSIONS, confidence: float = CONFIDENCE, key: str = "vec_id", vector: str = "embedding", where: Column | str | None = None) -> DataFrame:
    """(query_id, neighbour_id, rank, distance): the k nearest others by Euclidean distance of every vector, or of those that ``where`` names.

    Approximate: each true neighbour is missed with probability 1 - confidence at most. Equal distances
    are ranked by key. Keys may be of any type that can be ordered and keep it. Rows with a null key or
    vector, with a null, NaN or infinite element, or of a length other than the commonest are left out; of
    rows that share a key one is used. Queries with fewer than k others have fewer rows; an empty table
    gives an empty result. Columns that ``where`` doesn't name are neither read nor returned. Long vectors
    are whole: true distances use every element.
    """
    if k < 1:
        raise ValueError("k must be positive")
    spark = vectors.sparkSession
    key_type = vectors.schema[key].dataType
    schema = f"query_id {key_type.simpleString()}, neighbour_id {key_type.simpleString()}, rank int, distance double"
    asks = F.lit(True) if where is None else F.coalesce(F.expr(where) if isinstance(where, str) else where, F.lit(False))
    rows = _usable(vectors.withColumn("__asks", asks), key, vector)
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if sizes is None:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.size("v") == sizes.n)
    n, distinct = rows.agg(F.count("*"), F.countDistinct("key")).first()
    if distinct < n:
        rows = materialise(rows.groupBy("key").agg(F.min(F.struct("v", "asks")).alias("r")).select("key", "r.v", "r.asks"), "one-a-key")
    numbers = None
    if isinstance(key_type, T.IntegralType):
        rows = rows.select(F.col("key").cast("bigint").alias("id"), "v", "asks")
    else:
        numbers = materialise(rows.select("key").orderBy("key").select("key", F.monotonically_increasing_id().alias("id")), "keys")
        rows = rows.join(numbers, "key").select("id", "v", "asks")
    matrix, limit = projection(sizes.n, dimensions), chi2_quantile(confidence, dimensions)

    # the upper tree, from a sample whose size doesn't grow with the table
    depth = int(np.ceil(np.log2(max(1, min(distinct / CELL_ROWS, SAMPLE_ROWS / SAMPLE_OF_CELL)))))
    sample = np.zeros((0, dimensions))
    if depth:
        part = rows.where(F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(1 << 30)) < int(min(1.0, SAMPLE_ROWS / distinct) * (1 << 30)))
        sample = _project(part, matrix, None).select("y").toArrow().column("y")
        sample = _matrix(sample) if len(sample) else np.zeros((0, dimensions))
    tree = UpperTree(sample, depth)

    # boxes and sizes of the cells, then of their pieces
    y = [F.col("y")[i] for i in range(dimensions)]
    placed = _project(rows, matrix, tree)
    cells = placed.groupBy("cell").agg(F.count("*").alias("n"), F.sum(F.col("asks").cast("int")).alias("asking"), F.array(*map(F.min, y)).alias("low"), F.array(*map(F.max, y)).alias("high")).orderBy("cell").toArrow()
    at, counts, asking = (cells.column(c).to_numpy() for c in ("cell", "n", "asking"))
    low, high = _matrix(cells.column("low")), _matrix(cells.column("high"))
    ways = -(-counts // (2 * CELL_ROWS))
    first_piece = np.cumsum(ways) - ways
    of_cell, start = np.full(1 << depth, -1), np.zeros(1 << depth, np.int64)
    of_cell[at] = np.arange(len(at))
    start[at] = np.cumsum(asking) - asking
    cell_of_piece = np.repeat(np.arange(len(at)), ways)

    def with_piece(batches):
        for b in batches:
            cell = of_cell[b.column(4).to_numpy()]
            ids = b.column(0).to_numpy()
            piece = first_piece[cell] + (ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % ways[cell]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in range(4)), pa.array(piece.astype(np.int32))], names=["id", "v", "y", "asks", "piece"])

    def at_home(table: pa.Table) -> pa.Table:
        piece = table.column("piece")[0].as_py()
        ids, v, py = table.column("id").to_numpy(), _matrix(table.column("v")), _matrix(table.column("y"))
        out = [{"kind": 1, "piece": piece, "ids": ids, "v": v.ravel(), "y": py.ravel()}]
        own = np.flatnonzero(table.column("asks").to_numpy())
        if len(own):
            found, _ = search(ids[own], v[own], py[own], ids, v, py, k, np.full(len(own), np.inf), limit)
            far = _true(v[own], v, found)
            bound = np.where(found[:, -1] >= 0, far.max(1) ** 2 * (1 + 1e-9), np.finfo(float).max)
            visits = box_distance(py[own], low, high) < limit * bound[:, None]
            # queries of a strip are near each other; a cell's own queries follow one another
            strip = (start[at[cell_of_piece[piece]]] + np.arange(len(own))) // STRIP_QUERIES
            for s in np.unique(strip):
                q = strip == s
                asked = np.flatnonzero(np.isin(cell_of_piece, np.flatnonzero(visits[q].any(0))))
                out.append({"kind": 0, "piece": piece, "strip": s, "ids": ids[own][q], "v": v[own][q].ravel(), "y": py[own][q].ravel(), "bound": bound[q], "visits": asked[asked != piece], "hits": np.where(found[q] >= 0, ids[found[q]], -1).ravel(), "far": far[q].ravel()})
        columns = {c: pa.array([x.get(c) for x in out], kind) for c, kind in (("kind", pa.int32()), ("piece", pa.int32()), ("strip", pa.int32()), ("ids", pa.list_(pa.int64())), ("v", pa.list_(pa.float64())), ("y", pa.list_(pa.float64())), ("bound", pa.list_(pa.float64())), ("visits", pa.list_(pa.int32())))}
        columns["hits"] = pa.array([x.get("hits") for x in out], pa.list_(pa.int64()))
        columns["far"] = pa.array([x.get("far") for x in out], pa.list_(pa.float64()))
        return pa.table(columns)

    pieces = placed.mapInArrow(with_piece, f"id bigint, v {rows.schema['v'].dataType.simpleString()}, y array<float>, asks boolean, piece int")
    blocks = materialise(pieces.groupBy("piece").applyInArrow(at_home, _BLOCK), "pieces")
    asked = blocks.where("kind = 0")
    own = asked.select(F.posexplode("ids").alias("i", "query_id"), "hits", "far").select("query_id", F.posexplode(F.slice("far", F.col("i") * k + 1, F.lit(k))).alias("j", "distance"), F.element_at("hits", (F.col("i") * k + F.col("j") + 1).cast("int")).alias("neighbour_id"))
    own = own.where("not isnan(distance) and distance < double('infinity')").select("query_id", "neighbour_id", "distance")

    # strips of queries in tasks, the pieces they ask for streaming past
    strips, total = max(1, -(-int(asking.sum()) // STRIP_QUERIES)), len(cell_of_piece)
    parts = max(1, min(total, -(-2 * spark.sparkContext.defaultParallelism // strips)))
    tile = F.col("strip") * parts + F.pmod("piece", F.lit(parts))
    meet = asked.select("strip", F.explode("visits").alias("piece")).distinct()
    few = strips * total * 16 <= BROADCAST_BYTES
    there = blocks.where("kind = 1").drop("strip", "visits").join(F.broadcast(meet) if few else meet, "piece")
    columns = ("ids", "v", "y", "bound", "hits", "far")
    left = asked.select(F.explode(F.sequence(F.col("strip") * parts, F.col("strip") * parts + parts - 1)).alias("tile"), "kind", "piece", *columns)
    both = left.unionByName(there.select(tile.alias("tile"), "kind", "piece", *columns))
    wide = min(strips * parts, 20_000)
    both = both.repartitionById(wide, F.pmod("tile", F.lit(wide))).sortWithinPartitions("tile", "kind")

    def away(batches):
        def done():
            if held is not None:
                q_id, *_, best, dist, _ = held
                row, col = np.nonzero(np.isfinite(dist))
                if len(row):
                    yield pa.RecordBatch.from_arrays([pa.array(q_id[row]), pa.array(best[row, col]), pa.array(dist[row, col])], names=["query_id", "neighbour_id", "distance"])

        now, parts_of, held = None, [], None
        for b in batches:
            for i in range(len(b)):
                tile_no, kind = b.column(0)[i].as_py(), b.column(1)[i].as_py()
                ids, v, py = b.column(3)[i].values.to_numpy(), *(b.column(c)[i].values.to_numpy(zero_copy_only=False) for c in (4, 5))
                v, py = v.reshape(len(ids), -1), py.reshape(len(ids), -1)
                if tile_no != now:
                    yield from done()
                    now, parts_of, held = tile_no, [], None
                if kind == 0:
                    parts_of.append((ids, v, py, b.column(6)[i].values.to_numpy(), np.full(len(ids), b.column(2)[i].as_py())))
                    continue
                if not parts_of and held is None:
                    continue
                if held is None:
                    q_id, q, q_y, bound, home = (np.concatenate(x) for x in zip(*parts_of))
                    held, parts_of = [q_id, q, q_y, home, np.full((len(q_id), k), -1), np.full((len(q_id), k), np.inf), bound], []
                q_id, q, q_y, home, best, dist, bound = held
                # a query has searched its own piece already
                live = np.flatnonzero((home != b.column(2)[i].as_py()) & (box_distance(q_y, py.min(0)[None], py.max(0)[None])[:, 0] < limit * bound))
                if not len(live):
                    continue
                found, _ = search(q_id[live], q[live], q_y[live], ids, v, py, k, bound[live], limit)
                far = _true(q[live], v, found)
                far[far * far > bound[live, None]] = np.inf
                d = np.concatenate([dist[live], far], axis=1)
                who = np.concatenate([best[live], np.where(found >= 0, ids[found], -1)], axis=1)
                order = np.lexsort((who, d), axis=1)[:, :k]
                dist[live], best[live] = np.take_along_axis(d, order, 1), np.take_along_axis(who, order, 1)
                bound[live] = np.minimum(bound[live], dist[live, -1] ** 2 * (1 + 1e-9))
        yield from done()

    others = both.mapInArrow(away, "query_id bigint, neighbour_id bigint, distance double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "neighbour_id"))
    out = own.unionByName(others).withColumn("rank", rank.cast("int")).where(F.col("rank") <= k)
    if numbers is not None:
        for side in ("query_id", "neighbour_id"):
            out = out.join(numbers.select(F.col("id").alias(side), F.col("key").alias("__key")), side).drop(side).withColumnRenamed("__key", side)
    return out.select(F.col("query_id").cast(key_type), F.col("neighbour_id").cast(key_type), "rank", "distance")


def _project(rows: DataFrame, matrix: np.ndarray, tree: UpperTree | None) -> DataFrame:
    """``rows`` (id, v, asks) with their projections y and, by a tree, their cells."""

    def project(batches):
        for b in batches:
            if not len(b):
                continue
            y = (_matrix(b.column(1)) @ matrix).astype(np.float32)
            cell = tree.cells(y) if tree else np.zeros(len(b), np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _lists(y.ravel(), np.full(len(b), y.shape[1])), b.column(2), pa.array(cell)], names=["id", "v", "y", "asks", "cell"])

    return rows.select("id", "v", "asks").mapInArrow(project, f"id bigint, v {rows.schema['v'].dataType.simpleString()}, y array<float>, asks boolean, cell bigint")


def _true(q: np.ndarray, p: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Distances to the rows found, from the differences themselves; inf where there is none."""
    out = np.full(found.shape, np.inf)
    row, col = np.nonzero(found >= 0)
    gap = q[row] - p[found[row, col]]
    out[row, col] = np.sqrt(np.einsum("ij,ij->i", gap, gap))
    return out


def op3_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    """The ten nearest others of every vector whose id is divisible by 100, among all vectors."""
    return knn(read_table(spark, sf_dir, "embeddings"), where="vec_id % 100 = 0").withColumn("distance", F.round("distance", 6))


OP3_SQL = """
WITH d AS (SELECT q.vec_id AS query_id, c.vec_id AS neighbour_id, list_distance(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS distance
           FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, neighbour_id, rank::INT AS rank, round(n.distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id) AS rank FROM d) n WHERE rank <= 10"""
