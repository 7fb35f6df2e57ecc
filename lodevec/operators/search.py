"""Exact similarity search, similarity joins, rank fusion and re-ranking.

Ranks follow the score in descending order (rounded to 9 digits, so that the order of summation can't
flip them), then the id. NaN scores come last. Filters are Column predicates on the corpus and are
applied before scoring.
"""

from __future__ import annotations

from math import isfinite

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodevec.errors import ValidationError
from lodevec.functions.vector import check_metric, literal, score
from lodevec.operators import blocks
from lodevec.plans.components import connected_components
from lodevec.runtime import broadcast_if_small, discard, materialise, ranked


def _check_k(k: int) -> None:
    if isinstance(k, bool) or not isinstance(k, int) or k < 1:
        raise ValidationError("k must be a positive integer")


def _order(by: str = "score", key: str = "id") -> list[Column]:
    value = F.nanvl(F.col(by), F.lit(float("-inf")))
    return [F.round(value, 9).desc_nulls_last(), F.col(key)]


def _scored(corpus: DataFrame, query: list[float], metric: str, where: Column | str | None, key: str, vector: str) -> DataFrame:
    rows = corpus if where is None else corpus.where(where)
    return rows.withColumn("score", score(vector, literal(query), metric)).withColumnRenamed(key, "id")


def top_k(corpus: DataFrame, query: list[float], k: int, metric: str = "cosine", where: Column | str | None = None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k rows nearest to one vector, best first, with all their columns and the score."""
    _check_k(k)
    return _scored(corpus, query, metric, where, key, vector).orderBy(*_order()).limit(k)


def above_threshold(corpus: DataFrame, query: list[float], threshold: float, metric: str = "cosine", where: Column | str | None = None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """All rows with a score of at least ``threshold``, best first."""
    if not isfinite(threshold):
        raise ValidationError("the threshold must be finite")
    return _scored(corpus, query, metric, where, key, vector).where(F.col("score") >= threshold).orderBy(*_order())


def rank_by_similarity(corpus: DataFrame, query: list[float], metric: str = "cosine", key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """All rows, best first."""
    return _scored(corpus, query, metric, None, key, vector).orderBy(*_order())


def _ranked(pairs: DataFrame, k: int | None = None) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(*_order()))
    out = pairs.withColumn("rank", place)
    return out if k is None else out.where(F.col("rank") <= k)


#: Pairs that the strategy ``expression`` scores one by one, at most.
EXPRESSION_PAIRS = 500_000


def top_k_multi(queries: DataFrame, corpus: DataFrame, k: int, metric: str = "cosine", where: Column | str | None = None, query_key: str = "query_id", key: str = "vec_id", vector: str = "embedding", strategy: str = "blocks") -> DataFrame:
    """(query_id, rank, id, score): the k nearest rows of every query.

    ``blocks``: matrix products by tiles, each of which keeps k rows a query, then one small shuffle; for
    any sizes. ``expression``: a cross join scored inside the JVM, with the queries
    broadcast if they are few; suits a handful of queries. Beyond ``EXPRESSION_PAIRS``, where a row a pair
    would be scored and sorted, it goes by tiles too.
    """
    _check_k(k)
    check_metric(metric)
    rows = corpus if where is None else corpus.where(where)
    if strategy == "expression":
        q = queries.select(F.col(query_key).alias("query_id"), F.col(vector).alias("__q"))
        n, size = q.agg(F.count("*"), F.coalesce(F.max(F.size("__q")), F.lit(0))).first()
        if n * rows.count() <= EXPRESSION_PAIRS:
            pairs = rows.select(F.col(key).alias("id"), F.col(vector).alias("__v")).crossJoin(broadcast_if_small(q, n, 8 * size + 16))
            return _ranked(pairs.select("query_id", "id", score("__q", "__v", metric).alias("score")), k).select("query_id", "rank", "id", "score")

    pairs = blocks.best_of(blocks.packed(queries, query_key, vector), blocks.packed(rows, key, vector), lambda q, v: blocks.scores(q, v, metric), k)
    return _ranked(pairs, k).select("query_id", "rank", "id", "score")


def pairwise_similarity(left: DataFrame, right: DataFrame, on: str, metric: str = "cosine", vector: str = "embedding") -> DataFrame:
    """(on, score) of the rows that share an ordinal; both sides must have as many rows."""
    n, m = left.count(), right.count()
    if n != m:
        raise ValidationError(f"the sides have {n} and {m} rows")
    a = left.select(on, F.col(vector).alias("__a"))
    return a.join(right.select(on, F.col(vector).alias("__b")), on).select(on, score("__a", "__b", metric).alias("score"))


def similar_pairs(df: DataFrame, threshold: float, metric: str = "cosine", key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(a, b, score) with a < b and a score of at least ``threshold``; each pair of blocks is compared once."""
    check_metric(metric)

    def close(ids, v, other, w, same):
        s = blocks.scores(v, w, metric)
        near = s >= threshold
        x, y = np.nonzero(near & (ids[:, None] < other[None]) if same else near & (ids[:, None] != other[None]))
        return np.minimum(ids[x], other[y]), np.maximum(ids[x], other[y]), s[x, y]

    return blocks.per_pair(blocks.packed(df, key, vector), None, close, "a bigint, b bigint, score double", ["a", "b", "score"])


def _links_of_tile(threshold: float, metric: str, rows: int = 512, columns: int = 1024):
    """Work of ``blocks.per_tile`` over vectors (copies, x, ...): (a, null, links) of rows with links, (a, b, 0) of a spanning forest."""

    def work(ids, v, other, w, same):
        copies, v, of_other, w = v[:, 0], v[:, 1:], w[:, 0], w[:, 1:]
        n, kind = len(ids), np.float32 if copies.sum() + of_other.sum() < 1 << 24 else np.float64
        weight, other_weight = np.ascontiguousarray(copies, kind), np.ascontiguousarray(of_other, kind)
        every = ids if same else np.concatenate([ids, other])
        repeated = len(np.unique(every)) < len(every)
        links, label, edges = np.zeros(len(every)), np.arange(len(every)), []
        shift = 0 if same else n

        def join(crossing, i, j):
            """Unites what the pairs of one part join, each round over the first pair of every row and column."""
            nonlocal label
            while crossing.any():
                x, y = np.concatenate([np.flatnonzero(crossing.any(1)), crossing.argmax(0)]), np.concatenate([crossing.argmax(1)[crossing.any(1)], np.arange(crossing.shape[1])])
                real = crossing[x, y]
                x, y = x[real] + i, y[real] + j + shift
                to: dict[int, int] = {}
                for p, q, one, two in zip(x.tolist(), y.tolist(), label[x].tolist(), label[y].tolist()):
                    while one in to:
                        one = to[one]
                    while two in to:
                        two = to[two]
                    if one != two:
                        to[max(one, two)] = min(one, two)
                        edges.append((p, q))
                new = np.arange(len(every))
                for old in sorted(to):  # towards lesser ones, which are final by then
                    new[old] = new[to[old]]
                label = new[label]
                crossing &= label[i : i + len(crossing), None] != label[None, j + shift : j + shift + crossing.shape[1]]

        for i in range(0, n, rows):
            for j in range(i // columns * columns if same else 0, len(w), columns):
                near = blocks.scores(v[i : i + rows], w[j : j + columns], metric) >= threshold
                if same and j < i + rows:
                    near &= np.arange(i, i + len(near))[:, None] < np.arange(j, j + near.shape[1])[None]
                if repeated:
                    near &= ids[i : i + rows, None] != other[None, j : j + columns]
                as_number = near.astype(kind)
                links[i : i + len(near)] += as_number @ other_weight[j : j + columns]
                links[j + shift : j + shift + near.shape[1]] += weight[i : i + rows] @ as_number
                one, two = label[i : i + len(near)], label[j + shift : j + shift + near.shape[1]]
                if not (one.min() == one.max() == two.min() == two.max()):
                    join(near & (one[:, None] != two[None]), i, j)
        some, pairs = np.flatnonzero(links), np.array(edges, np.int64).reshape(-1, 2)
        b = pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(every[pairs[:, 1]])])
        return np.concatenate([every[some], every[pairs[:, 0]]]), b, np.concatenate([links[some], np.zeros(len(pairs))]).astype(np.int64)

    return work


def similar_classes(df: DataFrame, threshold: float, metric: str = "cosine", key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, class_id, links) of every row with a key and a vector: its class and the number of rows similar to it.

    A class is a connected component of the pairs at ``threshold``, named by its least key; a row without a
    similar one is a class of its own. Equal vectors are compared once and stand for all their copies, which
    have one another as links, so that a group of copies isn't expanded into its pairs. A tile counts the
    links of its rows and keeps a forest of the pairs that joins the same rows, so that pairs aren't written.
    """
    check_metric(metric)
    rows = df.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("bigint").alias("__key"), F.col(vector).cast("array<double>").alias("__v"))
    rows = rows.withColumn("__h", F.struct(F.xxhash64("__v"), F.xxhash64(F.lit(1), "__v")))
    firsts = materialise(rows.groupBy("__h").agg(F.min("__key").alias("a"), F.first("__v").alias("v"), F.count("*").alias("copies")), "distinct-vectors")
    weighted = firsts.select("a", F.concat(F.array(F.col("copies").cast("double")), "v").alias("v"))
    tiles = materialise(blocks.per_tile(blocks.packed(weighted, "a", "v"), _links_of_tile(threshold, metric), "a bigint, b bigint, links bigint", ["a", "b", "links"]), "similar")
    sizes = firsts.select("a", "copies", (score("v", "v", metric) >= threshold).alias("self"))
    near = tiles.where("b IS NULL").groupBy("a").agg(F.sum("links").alias("near"))
    roots = connected_components(tiles.where("b IS NOT NULL").select("a", "b")).withColumnsRenamed({"node": "a", "component": "root"})
    known = sizes.join(near, "a", "left").join(roots, "a", "left")
    # copies that aren't similar to themselves (zero vectors) are classes of their own
    found = known.select("a", "self", F.coalesce("root", "a").alias("root"), (F.coalesce("near", F.lit(0)) + F.when(F.col("self"), F.col("copies") - 1).otherwise(0)).alias("links"))
    owners = firsts.select("__h", F.col("a"))
    out = rows.select("__key", "__h").join(owners, "__h").join(found, "a")
    alone = ~F.col("self") & (F.col("links") == 0)
    return out.select(F.col("__key").alias(key), F.when(alone, F.col("__key")).otherwise(F.col("root")).alias("class_id"), F.col("links").cast("bigint").alias("links"))


def similarity_matrix(df: DataFrame, metric: str = "cosine", key: str = "vec_id", vector: str = "embedding", rows: DataFrame | None = None) -> DataFrame:
    """(i, j, score) of all ordered pairs, the diagonal's own scores included; with ``rows`` only i from there."""
    check_metric(metric)
    every = lambda ids, v, other, w: (np.repeat(ids, len(other)), np.tile(other, len(ids)), blocks.scores(v, w, metric).ravel())

    def both(ids, v, other, w, same):
        i, j, s = every(ids, v, other, w)
        return (i, j, s) if same else (np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([s, s]))

    own, schema, names = blocks.packed(df, key, vector), "i bigint, j bigint, score double", ["i", "j", "score"]
    if rows is None:
        return blocks.per_pair(own, None, both, schema, names)
    return blocks.per_pair(blocks.packed(rows, key, vector), own, lambda *x: every(*x[:4]), schema, names)


#: Undecided pairs that one task may finish, and rounds after which components are looked for.
LOCAL_PAIRS, ROUNDS = 1_000_000, 6


def _first_removed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The rows that the greedy pass removes from a graph of pairs a < b."""
    order = np.lexsort((b, a))
    kept_or_gone: dict[int, bool] = {}
    for x, y in zip(a[order].tolist(), b[order].tolist()):
        if not kept_or_gone.setdefault(x, False):
            kept_or_gone[y] = True
    return np.array([x for x, gone in kept_or_gone.items() if gone], np.int64)


def _finished(edges: DataFrame, by: str | None) -> DataFrame:
    """(__gone) of components that are decided in one task each, or of all pairs in one."""

    def decide(table: pa.Table) -> pa.Table:
        return pa.table({"__gone": _first_removed(table.column("a").to_numpy(), table.column("b").to_numpy())})

    return edges.groupBy(by or F.lit(0).alias("__all")).applyInArrow(decide, "__gone bigint")


def deduplicate(df: DataFrame, threshold: float, metric: str = "cosine", key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The rows that a greedy pass in the order of keys keeps: those without a kept earlier row as similar.

    The pass is the lexicographically first independent set of the graph of similar pairs. Up to
    ``LOCAL_PAIRS`` of pairs one task decides. Beyond, it's found in rounds: an undecided row without an
    undecided or kept earlier neighbour is kept, and its later neighbours go. Chains would need a round for
    every other link, so after ``ROUNDS`` the components of what is left are decided by a task each, but for
    those of too many pairs, which go on in rounds.
    """
    if not isfinite(threshold):
        raise ValidationError("the threshold must be finite")
    edges = materialise(similar_pairs(df, threshold, metric, key, vector).select("a", "b"), "similar")
    gone, number = [], 0
    while (left := edges.count()) > LOCAL_PAIRS:
        number += 1
        if number % ROUNDS == 0:
            tagged = materialise(edges.join(connected_components(edges).withColumnRenamed("node", "a"), "a"), "components")
            sizes = tagged.groupBy("component").count()
            tagged = materialise(tagged.join(sizes, "component"), "sized")
            gone.append(materialise(_finished(tagged.where(F.col("count") <= LOCAL_PAIRS), "component"), "removed"))
            edges = materialise(tagged.where(F.col("count") > LOCAL_PAIRS).select("a", "b"), "similar")
            continue
        free = edges.select("a").distinct().join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_anti")  # earlier ends that no earlier row can still remove
        out = materialise(edges.join(free, "a").select(F.col("b").alias("__gone")).distinct(), "removed")
        gone.append(out)
        rest = edges.join(out, edges["a"] == out["__gone"], "left_anti").join(out.withColumnRenamed("__gone", "__b"), F.col("b") == F.col("__b"), "left_anti")
        old, edges = edges, materialise(rest, "similar")
        discard(old)
    if left:
        gone.append(_finished(edges, None))
    if not gone:
        return df
    all_gone = gone[0]
    for more in gone[1:]:
        all_gone = all_gone.unionByName(more)
    return df.join(all_gone, df[key] == all_gone["__gone"], "left_anti")


def mmr_search(queries: DataFrame, corpus: DataFrame, k: int, lam: float = 0.5, fetch_k: int | None = None, metric: str = "cosine", query_key: str = "query_id", key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): k diverse rows a query by maximal marginal relevance.

    From the ``fetch_k`` (4k) nearest, each step takes the greatest lam * relevance - (1 - lam) * the
    greatest similarity to a row taken (0 at least); ties go to the more relevant. ``score`` is the relevance.
    """
    if k <= 0:
        return queries.sparkSession.createDataFrame([], "query_id bigint, rank int, id bigint, score double")
    pool = top_k_multi(queries, corpus, max(fetch_k or 4 * k, k), metric, None, query_key, key, vector)
    pool = pool.join(corpus.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("__v")), "id")

    def choose(pdf):
        pdf = pdf.sort_values("rank")
        v, relevance = np.stack(pdf["__v"]), pdf["score"].to_numpy()
        near, taken, left = np.zeros(len(pdf)), [], np.ones(len(pdf), bool)
        for _ in range(min(k, len(pdf))):
            value = np.where(left, np.round(lam * relevance - (1 - lam) * near, 12), -np.inf)
            i = int(value.argmax())
            taken.append(i)
            left[i] = False
            near = np.maximum(near, blocks.scores(v, v[i : i + 1], metric)[:, 0])
        out = pdf.iloc[taken][["query_id", "rank", "id", "score"]].copy()
        out["rank"] = np.arange(1, len(out) + 1, dtype=np.int32)
        return out

    return pool.select("query_id", "rank", "id", "score", "__v").groupBy("query_id").applyInPandas(choose, "query_id bigint, rank int, id bigint, score double")


def rerank(results: DataFrame, metric: str = "cosine", original_weight: float = 0.5, rerank_weight: float = 0.5, query_vector: str = "query_vector", vector: str = "embedding") -> DataFrame:
    """Rows (query_id, id, score, query vector, vector) with the score mixed with a second one, and new ranks."""
    mixed = original_weight * F.col("score") + rerank_weight * score(query_vector, vector, metric)
    return _ranked(results.drop("rank").withColumn("score", mixed)).drop(query_vector, vector)


def fuse_ranked_lists(lists: DataFrame, k: float = 60) -> DataFrame:
    """(id, score, rank) by reciprocal rank fusion of rows (list_id, rank, id).

    The rank in a list counts from 1; an id that a list repeats counts each time; ties go to the id seen
    first, by list and rank.
    """
    fused = lists.groupBy("id").agg(F.sum(1 / (k + F.col("rank"))).alias("score"), F.min(F.struct("list_id", "rank")).alias("__first"))
    return ranked(fused, [F.round("score", 12).desc(), F.col("__first")]).drop("__first")


def normalize_scores(rows: DataFrame, method: str, by: list[str], score_column: str = "score") -> DataFrame:
    """``rows`` with the scores of each list as min-max, z-score (population) or sigmoid values."""
    s, w = F.col(score_column).cast("double"), Window.partitionBy(*by)
    if method == "sigmoid":
        new = 1 / (1 + F.exp(-s))
    elif method == "min-max":
        low, high = F.min(s).over(w), F.max(s).over(w)
        new = F.coalesce(F.try_divide(s - low, high - low), F.when(s.isNotNull(), 1.0))
    elif method == "z-score":
        new = F.coalesce(F.try_divide(s - F.avg(s).over(w), F.stddev_pop(s).over(w)), F.when(s.isNotNull(), 0.0))
    else:
        raise ValidationError(f"unknown method {method!r}")
    return rows.withColumn(score_column, new)

