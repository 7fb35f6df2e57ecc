"""Clusterings that depend on the order of rows (greedy, online) or on all pairs (by density).

Rows are taken in the order of their ids. These algorithms are sequential: one task holds the ids and
vectors of one clustering. For larger tables give ``by``, columns that part it into independent clusterings.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodevec.errors import ValidationError
from lodevec.functions.vector import check_metric
from lodevec.operators import blocks, quality
from lodevec.operators.blocks import scores
from lodevec.rng import permutation
from lodevec.runtime import materialise, ranked


@dataclass(frozen=True)
class GreedyConfig:
    threshold: float = 0.9
    min_size: int = 5
    max_clusters: int = 5
    metric: str = "cosine"
    strategy: str = "centroid"  # or "average-similarity"
    shuffle: bool = False
    seed: int = 42

    def __post_init__(self):
        check_metric(self.metric)
        if self.max_clusters < 1:
            raise ValidationError("max_clusters must be at least 1")
        if self.min_size < 0:
            raise ValidationError("min_size can't be negative")
        if self.strategy not in ("centroid", "average-similarity"):
            raise ValidationError(f"unknown strategy {self.strategy!r}")


PRESETS = {
    "high-precision": GreedyConfig(0.95, 3, 10),
    "balanced": GreedyConfig(0.85, 5, 5),
    "performance": GreedyConfig(0.75, 10, 3),
    "legacy": GreedyConfig(0.0, 1, 1),
}


def preset(name: str) -> GreedyConfig:
    if name not in PRESETS:
        raise ValidationError(f"unknown preset {name!r}")
    return PRESETS[name]


def _mean(v: np.ndarray) -> np.ndarray:
    return v.astype(np.float64).mean(0).astype(np.float32)


class Leader:
    """Leader clustering in one pass: a row joins the cluster it's most similar to, if by ``threshold``, or begins one.

    Centroids are running means in single precision. Members' vectors are kept only where the strategy needs them.
    """

    def __init__(self, threshold: float, metric: str = "cosine", strategy: str = "centroid"):
        self.threshold, self.metric, self.strategy = threshold, check_metric(metric), strategy
        self.centroids = np.zeros((0, 0), np.float32)
        self.sizes: list[int] = []
        self.members: list[list[np.ndarray]] = []

    def add(self, v: np.ndarray) -> int:
        v = np.asarray(v, np.float32)
        wide = v[None].astype(np.float64)
        n = len(self.sizes)
        if n:
            if self.strategy == "centroid":
                s = scores(wide, self.centroids[:n].astype(np.float64), self.metric)[0]
            else:
                s = np.array([scores(wide, np.stack(m).astype(np.float64), self.metric)[0].mean() for m in self.members])
            best = int(np.nanargmax(s)) if not np.isnan(s).all() else 0
            if s[best] >= self.threshold:
                k = self.sizes[best] + 1
                self.centroids[best] += (v - self.centroids[best]) / np.float32(k)
                self.sizes[best] = k
                if self.strategy != "centroid":
                    self.members[best].append(v)
                return best
        if n == len(self.centroids):
            grown = np.zeros((max(8, 2 * n), len(v)), np.float32)
            if n:
                grown[:n] = self.centroids[:n]
            self.centroids = grown
        self.centroids[n] = v
        self.sizes.append(1)
        if self.strategy != "centroid":
            self.members.append([v])
        return n


def _merge_closest(groups: list[np.ndarray], v: np.ndarray, limit: int, metric: str) -> list[np.ndarray]:
    """Merges the two clusters of the most similar centroids until there are ``limit``; a merged one goes last."""
    means = [_mean(v[g]) for g in groups]
    while len(groups) > limit:
        m = np.stack(means).astype(np.float64)
        s = scores(m, m, metric)
        s[np.tril_indices(len(m))] = -np.inf
        i, j = divmod(int(s.argmax()), len(m))
        both = np.concatenate([groups[i], groups[j]])
        groups = [g for k, g in enumerate(groups) if k not in (i, j)] + [both]
        means = [x for k, x in enumerate(means) if k not in (i, j)] + [_mean(v[both])]
    return groups


def _greedy_groups(v: np.ndarray, config: GreedyConfig) -> list[np.ndarray]:
    """The rows of each cluster before any is merged: greedy pass, small clusters spread over the others."""
    order = np.array(permutation(len(v), config.seed)) if config.shuffle else np.arange(len(v))
    leader = Leader(config.threshold, config.metric, config.strategy)
    first = np.array([leader.add(v[i]) for i in order])
    groups = [order[first == c] for c in range(len(leader.sizes))]
    good = [k for k, g in enumerate(groups) if len(g) >= config.min_size]
    if not good:
        groups = [np.concatenate(groups)]
    elif len(good) < len(groups):
        means = leader.centroids[good].astype(np.float64)
        taken = [[groups[k]] for k in good]
        for k, g in enumerate(groups):
            if len(g) < config.min_size:
                for i in g:
                    taken[int(scores(v[i][None].astype(np.float64), means, config.metric)[0].argmax())].append(np.array([i]))
        groups = [np.concatenate(t) for t in taken]
    return groups


def nested_labels(v: np.ndarray, config: GreedyConfig, limits: list[int]) -> np.ndarray:
    """A column of ``greedy_labels`` for each of the ascending limits on clusters: each merges on from the next one's."""
    out = np.zeros((len(v), len(limits)), np.int64)
    if not len(v):
        return out
    v = np.asarray(v, np.float32)
    groups = _greedy_groups(v, config)
    for i in range(len(limits) - 1, -1, -1):
        groups = _merge_closest(groups, v, limits[i], config.metric)
        for c, g in enumerate(groups):
            out[g, i] = c
    return out


def greedy_labels(v: np.ndarray, config: GreedyConfig) -> np.ndarray:
    """The cluster of every row: greedy pass, small clusters spread over the others, closest clusters merged."""
    return nested_labels(v, config, [config.max_clusters])[:, 0]


def _labelled(df: DataFrame, labels, by: list[str], key: str, vector: str, column: str = "cluster_id bigint") -> DataFrame:
    rows = df.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(*by, F.col(key), F.col(vector).cast("array<double>").alias("__v"))

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key, kind="stable")
        if pdf["__v"].map(len).nunique() > 1:
            raise ValidationError("vectors differ in length")
        return pdf[[*by, key]].assign(**{column.split()[0]: list(labels(np.stack(pdf["__v"])))})

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in [*by, key])
    return rows.groupBy(*(by or [F.lit(0).alias("__all")])).applyInPandas(work, f"{kinds}, {column}")


def cluster_embeddings(df: DataFrame, config: GreedyConfig = GreedyConfig(), by: list[str] | None = None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(by, key, cluster_id) of every row by greedy clustering; nothing is dropped."""
    return _labelled(df, lambda v: greedy_labels(v, config), by or [], key, vector)


def cluster_summaries(df: DataFrame, assigned: DataFrame, metric: str = "cosine", key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(cluster_id, size, centroid, cohesion) of a clustering (key, cluster_id) of ``df``; noise (-1) is no cluster.

    Members and labels are the rows of ``assigned`` themselves; ``quality.cluster_stats`` gives the statistics.
    """
    members = df.where(F.col(vector).isNotNull()).join(assigned.where("cluster_id >= 0").select(key, "cluster_id"), key).select("cluster_id", key, vector)
    shape = quality.cohesion(members, metric, vector, key)
    return quality.centroids(members, vector).drop("size").join(shape, "cluster_id").select("cluster_id", "size", "centroid", "cohesion")


@dataclass
class IncrementalClusterer:
    """Online leader clustering of rows as they come; the state is the centroids and sizes alone.

    Which row is in which cluster is what ``add`` returns and the caller keeps; with the rows at hand
    ``cluster_summaries`` gives members' cohesion, and ``rebalance`` clusters them again.
    """

    config: GreedyConfig = field(default_factory=GreedyConfig)

    def __post_init__(self):
        self._leader = Leader(self.config.threshold, self.config.metric)

    def add(self, v) -> int:
        """The cluster of one more row."""
        return self._leader.add(np.asarray(v))

    def add_batch(self, rows) -> list[int]:
        return [self.add(v) for v in rows]

    @property
    def size(self) -> int:
        return sum(self._leader.sizes)

    def clusters(self) -> list[tuple[np.ndarray, int]]:
        return [(self._leader.centroids[c].copy(), n) for c, n in enumerate(self._leader.sizes)]

    def stats(self) -> dict:
        n = self._leader.sizes
        return {"clusters": len(n), "rows": sum(n), "average_size": sum(n) / len(n) if n else 0.0}

    def state(self) -> tuple[np.ndarray, list[int]]:
        """Centroids and sizes, from which ``restore`` goes on."""
        n = len(self._leader.sizes)
        return self._leader.centroids[:n].copy(), list(self._leader.sizes)

    def restore(self, centroids: np.ndarray, sizes: list[int]) -> None:
        self._leader = Leader(self.config.threshold, self.config.metric)
        if sizes:
            self._leader.centroids, self._leader.sizes = np.array(centroids, np.float32), list(sizes)

    def rebalance(self, rows) -> list[int]:
        """Clusters vectors anew, all of them at once, and goes on from there; the cluster of each."""
        v = [np.asarray(x, np.float32) for x in rows]
        if not v:
            self.restore(np.zeros((0, 0)), [])
            return []
        labels = greedy_labels(np.stack(v), self.config)
        self.restore(np.stack([_mean(np.stack(v)[labels == c]) for c in range(labels.max() + 1)]), np.bincount(labels).tolist())
        return labels.tolist()


def distances(v: np.ndarray, metric: str) -> np.ndarray:
    s = scores(v, v, metric)
    d = 1 - s if metric in ("cosine", "dot") else 1 / s - 1
    d = (d + d.T) / 2
    np.fill_diagonal(d, 0)
    return d


def _distances_from(x: np.ndarray, v: np.ndarray, nodes: np.ndarray, metric: str, rows: int = 512) -> np.ndarray:
    """Distances of one vector to the named rows of v; a pair's value depends neither on its order nor on the other rows."""
    if len(nodes) > rows:  # temporary arrays that fit the cache
        return np.concatenate([_distances_from(x, v, nodes[i : i + rows], metric) for i in range(0, len(nodes), rows)])
    v = v[nodes]
    if metric == "euclidean":
        apart = v - x
        return np.sqrt(np.einsum("ij,ij->i", apart, apart))
    if metric == "manhattan":
        return np.abs(v - x).sum(1)
    product = np.einsum("ij,ij->i", v, np.broadcast_to(x, v.shape))
    if metric == "dot":
        return 1 - product
    norms = np.sqrt(np.einsum("ij,ij->i", v, v)) * np.sqrt(np.einsum("ij,ij->i", x[None], x[None]))
    return 1 - np.divide(product, norms, out=np.zeros_like(product), where=norms != 0)


def _nearest(a: np.ndarray, b: np.ndarray, k: int, metric: str, same: bool, rows: int = 128):
    """For each row of a (its number, the k nearest rows of b, their distances), in memory of ``rows`` * len(b); ``same``: b is a, a row isn't its own.

    Matrix products find the candidates, with a margin for their rounding; their distances are taken anew.
    """
    for i in range(0, len(a), rows):
        part = a[i : i + rows]
        s = scores(part, b, metric)
        if same:
            s[np.arange(len(part)), np.arange(i, i + len(part))] = -np.inf
        low = np.partition(s, len(b) - k, axis=1)[:, len(b) - k]
        if metric == "euclidean":  # the margin holds for the squares, which the products are taken from
            far = 1 / np.maximum(low, 1e-300) - 1
            margin = 1e-12 * (1 + (part * part).sum(1) + (b * b).sum(1).max())
            low = 1 / (1 + np.sqrt(far * far + margin)) - 1e-12
        else:
            low = low - 1e-12 * (1 + np.abs(low) + (np.sqrt((part * part).sum(1) * (b * b).sum(1).max()) if metric == "dot" else 0))
        for j in range(len(part)):
            near = np.flatnonzero(s[j] >= low[j])
            d = _distances_from(part[j], b, near, metric)
            least = np.argpartition(d, k - 1)[:k]
            yield i + j, near[least], d[least]


def _core(v: np.ndarray, k: int, metric: str, rows: int = 128) -> np.ndarray:
    """Each row's distance to its k-th nearest other row."""
    return np.array([d.max() for _, _, d in _nearest(v, v, k, metric, True, rows)])


def _prim(core: np.ndarray, distances_to: Callable[[int, np.ndarray], np.ndarray], side: np.ndarray | None = None) -> np.ndarray:
    """(from, to, weight) rows of Prim's tree from node 0, ties to the last node, sorted by weight.

    A weight is the distance, or a core distance of its ends if that is greater. ``distances_to(node, nodes)``
    is only asked for nodes that the new node could still bring nearer; no row of distances is kept.
    With ``side`` only pairs of nodes of different sides are joined.
    """
    n = len(core)
    weight, source, open_ = np.full(n, np.inf), np.zeros(n, np.int64), np.ones(n, bool)
    node, out = 0, []
    nodes, at, own, own_side = np.arange(n), 0, core, side
    for left in range(n - 1, 0, -1):
        open_[at], weight[at] = False, np.inf
        if left < 0.9 * len(nodes):
            nodes, weight, source, own = nodes[open_], weight[open_], source[open_], own[open_]
            own_side = own_side if side is None else own_side[open_]
            open_ = np.ones(left, bool)
        least = np.maximum(own, core[node])
        able = open_ & (weight > least)
        near = np.flatnonzero(able if side is None else able & (own_side != side[node]))
        new = np.maximum(least[near], distances_to(node, nodes[near]))
        closer = new < weight[near]
        weight[near[closer]], source[near[closer]] = new[closer], node
        at = len(nodes) - 1 - int(weight[::-1].argmin())
        out.append((source[at], nodes[at], weight[at]))
        node = int(nodes[at])
    return np.array(sorted(out, key=lambda e: e[2]), float).reshape(-1, 3)


def spanning_tree(reach: np.ndarray) -> np.ndarray:
    """Prim's tree over a whole matrix of weights."""
    return _prim(np.full(len(reach), -np.inf), lambda node, nodes: reach[node, nodes])


def density_labels(v: np.ndarray, min_size: int = 5, min_samples: int | None = None, metric: str = "euclidean") -> np.ndarray:
    """HDBSCAN: the cluster of every row, -1 for noise; the whole may be one cluster.

    Core distance to the ``min_samples``-th neighbour, tree over mutual reachability, condensed by
    ``min_size``, clusters by excess of mass (a parent wins ties). Distances are taken as they are
    needed, so that memory grows by n, and time by n * n.
    """
    n = len(v)
    if n < min_size:
        return np.full(n, -1)
    v = np.ascontiguousarray(v, np.float64)
    k = min(min_samples or min_size, n - 1)
    core = _core(v, k, metric) if n > 1 else np.zeros(1)

    return _tree_labels(n, _prim(core, lambda node, nodes: _distances_from(v[node], v, nodes, metric)), min_size)


def _tree_labels(n: int, tree: np.ndarray, min_size: int) -> np.ndarray:
    """The clusters of a spanning tree (from, to, weight) of n nodes, sorted by weight."""
    # single linkage: node n + i merges two nodes
    root, size = list(range(2 * n)), [1] * n + [0] * n
    left, right, height = [0] * n, [0] * n, [0.0] * n

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, (a, b, w) in enumerate(tree):
        x, y, new = find(int(a)), find(int(b)), n + i
        root[x] = root[y] = new
        left[i], right[i], height[i], size[new] = x, y, w, size[x] + size[y]

    def points(node: int) -> list[int]:
        stack, out = [node], []
        while stack:
            x = stack.pop()
            if x < n:
                out.append(x)
            else:
                stack += [left[x - n], right[x - n]]
        return out

    # condensed clusters from the top: birth, stability, children, points that fall out
    birth, stability, children, fallen, of = [0.0], [0.0], [[]], [[]], {n + len(tree) - 1: 0}
    for i in range(len(tree) - 1, -1, -1):
        c = of.get(n + i)
        if c is None:
            continue
        density = 1 / height[i] if height[i] > 0 else 1e10
        sides = (left[i], right[i])
        large = [s for s in sides if size[s] >= min_size]
        gain = max(0.0, density - birth[c])
        if len(large) == 2:
            for s in sides:
                stability[c] += gain * size[s]
                of[s] = len(birth)
                children[c].append(len(birth))
                birth.append(density)
                stability.append(0.0)
                children.append([])
                fallen.append([])
            continue
        if large:
            of[large[0]] = c
        for s in sides:
            if s not in large:
                out = points(s)
                fallen[c] += out
                stability[c] += gain * len(out)

    best, chosen = stability[:], [False] * len(birth)
    for c in range(len(birth) - 1, -1, -1):  # children have greater numbers
        below = sum(best[x] for x in children[c])
        chosen[c] = not children[c] or stability[c] >= below
        best[c] = stability[c] if chosen[c] else below
    labels, name = np.full(n, -1), 0
    stack = [(0, -1)]
    names: dict[int, int] = {}
    while stack:
        c, inside = stack.pop()
        mine = c if inside < 0 and chosen[c] else inside
        if mine >= 0:
            names.setdefault(mine, -1)
            labels[fallen[c]] = mine
        stack += [(x, mine) for x in children[c]]
    for c in sorted(names):
        labels[labels == c] = -2 - name
        name += 1
    return np.where(labels < -1, -2 - labels, -1)


#: Rows that one task clusters by density; more are compared by tiles.
DENSITY_ROWS = 20_000


def _least_edges(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The places of the edges of a least spanning forest."""
    root, kept = list(range(n)), []
    order = np.argsort(w, kind="stable")
    for at in range(0, len(order), 1 << 20):
        part = order[at : at + (1 << 20)]
        for e, x, y in zip(part.tolist(), a[part].tolist(), b[part].tolist()):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            while root[y] != y:
                root[y] = root[root[y]]
                y = root[y]
            if x != y:
                root[y] = x
                kept.append(e)
    return np.array(kept, np.int64)


def _sparse_prim(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray:
    """``_prim`` over the edges of a connected graph, by the same rules."""
    one, two, weight = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([w, w])
    order = np.argsort(one, kind="stable")
    two, weight = two[order], weight[order]
    first = np.searchsorted(one[order], np.arange(n + 1)).tolist()
    best, source, done, heap, out, node = [np.inf] * n, [0] * n, bytearray(n), [], [], 0
    while True:
        done[node] = 1
        lo, hi = first[node], first[node + 1]
        for x, d in zip(two[lo:hi].tolist(), weight[lo:hi].tolist()):
            if not done[x] and d < best[x]:
                best[x], source[x] = d, node
                heappush(heap, (d, -x))
        while heap and done[-heap[0][1]]:
            heappop(heap)
        if not heap:
            break
        d, node = heappop(heap)
        node = -node
        out.append((source[node], node, d))
    return np.array(sorted(out, key=lambda e: e[2]), float).reshape(-1, 3)


def _density_by_tiles(rows: DataFrame, n: int, min_size: int, k: int, metric: str) -> DataFrame:
    """(at, cluster_id) of n rows (at, v), at from 0, as ``density_labels`` finds them.

    A least tree of all pairs lies within the least trees of the tiles, so that tiles find core distances
    and trees on their own, and one task joins the trees, whose edges are about one a row and strip. The pairs
    of a row and its k nearest are kept too: only they can be as near as an edge of the tree without being
    one, and among equals the order of the nodes decides.
    """

    def nearest(ids, v, other, w, same):
        found = [(ids[i], other[near], d) for i, near, d in _nearest(v, w, min(k, len(w) - same), metric, same)] if len(w) > same else []
        if not same:
            found += [(other[i], ids[near], d) for i, near, d in _nearest(w, v, min(k, len(v)), metric, False)]
        return (np.repeat([i for i, _, _ in found], [len(x) for _, x, _ in found]), *(np.concatenate([f[c] for f in found]) for c in (1, 2))) if found else None

    near = blocks.per_tile(blocks.packed(rows, "at", "v"), nearest, "at bigint, other bigint, d double", ["at", "other", "d"])
    near = near.groupBy("at").agg(F.slice(F.sort_array(F.collect_list(F.struct("d", "other"))), 1, k).alias("near"))
    near = materialise(near.withColumn("core", F.element_at("near", -1)["d"]), "nearest")
    cored = rows.join(near.select("at", "core"), "at").select("at", F.concat(F.array("core"), "v").alias("v"))

    def tree(ids, v, other, w, same):
        if not same:
            ids, v = np.concatenate([ids, other]), np.concatenate([v, w])
        if len(v) < 2:
            return None
        own, core, side = np.ascontiguousarray(v[:, 1:]), np.ascontiguousarray(v[:, 0]), None if same else np.arange(len(v)) >= len(v) - len(w)
        out = _prim(core, lambda node, nodes: _distances_from(own[node], own, nodes, metric), side)
        return ids[out[:, 0].astype(np.int64)], ids[out[:, 1].astype(np.int64)], out[:, 2]

    edges = blocks.per_tile(blocks.packed(cored, "at", "v"), tree, "a bigint, b bigint, w double", ["a", "b", "w"]).withColumn("tree", F.lit(True))
    pairs = near.select("at", "core", F.explode("near").alias("x")).select("at", "core", "x.other", "x.d")
    pairs = pairs.join(near.select(F.col("at").alias("other"), F.col("core").alias("other_core")), "other")
    pairs = pairs.select(F.col("at").alias("a"), F.col("other").alias("b"), F.greatest("d", "core", "other_core").alias("w"), F.lit(False).alias("tree"))
    all_edges = materialise(edges.unionByName(pairs), "edges")

    def label(table: pa.Table) -> pa.Table:
        a, b, w, of_tree = (table.column(c).to_numpy() for c in ("a", "b", "w", "tree"))
        of_tree = np.flatnonzero(of_tree)
        kept = np.zeros(len(a), bool)
        kept[of_tree[_least_edges(n, a[of_tree], b[of_tree], w[of_tree])]] = True
        kept |= ~table.column("tree").to_numpy()
        labels = _tree_labels(n, _sparse_prim(n, a[kept], b[kept], w[kept]), min_size)
        return pa.table({"at": np.arange(n), "cluster_id": labels.astype(np.int64)})

    return all_edges.groupBy(F.lit(0).alias("__all")).applyInArrow(label, "at bigint, cluster_id bigint")


def hdbscan(df: DataFrame, min_size: int = 5, min_samples: int | None = None, metric: str = "euclidean", by: list[str] | None = None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(by, key, cluster_id) by density, -1 for noise.

    Up to ``DENSITY_ROWS`` rows, and with ``by``, a clustering is one task, whose memory grows by n and time by n * n.
    More rows are compared by tiles, and one task holds the edges of the trees.
    """
    check_metric(metric)
    if min_size < 2:
        raise ValidationError("min_size must be at least 2")
    if min_samples is not None and min_samples < 1:
        raise ValidationError("min_samples must be at least 1")
    rows = df.where(F.col(key).isNotNull() & F.col(vector).isNotNull())
    n = 0 if by else rows.count()
    if n <= max(DENSITY_ROWS, min_size):
        return _labelled(df, lambda v: density_labels(v, min_size, min_samples, metric), by or [], key, vector)
    rows = ranked(rows.select(F.col(key), F.col(vector).cast("array<double>").alias("v")), [F.col(key)], "at").withColumn("at", F.col("at").cast("bigint") - 1)
    rows = materialise(rows.select("at", F.col(key), "v"), "numbered")
    labels = _density_by_tiles(rows.select("at", "v"), n, min_size, min(min_samples or min_size, n - 1), metric)
    return rows.select("at", F.col(key)).join(labels, "at").select(F.col(key), "cluster_id")


def core_distances(df: DataFrame, min_samples: int, metric: str = "euclidean", key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, core_distance) of all rows, by blocks: the distributed first stage of the density clustering."""
    from lodevec.operators.search import top_k_multi

    near = top_k_multi(df.withColumnRenamed(key, "query_id"), df, min_samples + 1, metric, key=key, vector=vector).where("id <> query_id")
    d = 1 - F.col("score") if metric in ("cosine", "dot") else 1 / F.col("score") - 1
    ordered = near.groupBy("query_id").agg(F.sort_array(F.collect_list(d)).alias("d"))
    return ordered.select(F.col("query_id").alias("id"), F.element_at("d", F.least(F.lit(min_samples), F.size("d"))).alias("core_distance"))


def optimal_k(df: DataFrame, min_k: int = 2, max_k: int | None = None, metric: str = "cosine", method: str = "silhouette", key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(k, silhouette, within, chosen): greedy clusterings with at most k clusters, their measures, and the best one.

    ``silhouette`` takes the greatest (the first of equals), ``elbow`` the sharpest bend of the sum of
    distances within clusters (min_k where there are fewer than three values). The greedy pass and the
    pairs of rows are gone through once for all k.
    """
    if min_k < 2:
        raise ValidationError("min_k must be at least 2")
    if method not in ("silhouette", "elbow"):
        raise ValidationError(f"unknown method {method!r}")
    n = df.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).count()
    last = max(min_k, min(10, n // 2) if max_k is None else max_k)
    ks = list(range(min_k, last + 1))
    own = _labelled(df, lambda v: nested_labels(v, GreedyConfig(0.0, 1, last, metric), ks), [], key, vector, "cluster_ids array<bigint>")
    members = df.select(F.col(key), F.col(vector)).join(materialise(own, "nested-labels"), key)
    found = {r.pos: r.silhouette for r in quality.nested_silhouettes(members, metric, vector, key).collect()}
    within = [quality.within_cluster_distance(members.withColumn("cluster_id", F.col("cluster_ids")[i]), metric, vector).first()[0] for i in range(len(ks))]
    rows = [(k, float(found.get(i, 0.0)), float(within[i])) for i, k in enumerate(ks)]
    if method == "silhouette":
        best = max(rows, key=lambda r: (round(r[1], 12), -r[0]))[0]
    else:
        w = [r[2] for r in rows]
        bends = [w[i - 1] - 2 * w[i] + w[i + 1] for i in range(1, len(w) - 1)]
        best = rows[1 + int(np.argmax(np.round(bends, 12)))][0] if bends else min_k
    return df.sparkSession.createDataFrame([(*r, r[0] == best) for r in rows], "k int, silhouette double, within double, chosen boolean")

