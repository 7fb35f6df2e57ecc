"""Approximate search by hierarchical proximity graphs, one for each shard of the corpus.

``build`` gives one binary row a shard, which can be written and read again; ``update`` adds and removes
items; ``search`` brings each shard together with the blocks of queries, reads it once, takes all queries
through the graph in step as array operations, and merges the shards' answers by one small shuffle.
"""

from __future__ import annotations

import json
import struct
from heapq import heapify, heappop, heappush
from math import floor, log

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodevec.errors import DimensionMismatchError, ValidationError
from lodevec.functions.vector import check_metric
from lodevec.operators import blocks
from lodevec.operators.search import _ranked
from lodevec.rng import generator

#: Rows of a shard, about; queries that meet a copy of a shard, about.
SHARD_ROWS, QUERY_ROWS = 20_000, 50_000
#: Items that ``add_batch`` adds in bulk, at least; nodes that a step of a batch of searches follows.
BULK_ROWS, AHEAD = 64, 4


class HnswIndex:
    """A navigable graph over (id, vector, metadata) items, after Malkov and Yashunin.

    Neighbours are the closest ones; an over-full node drops its farthest with the edges back. Removed
    items stay in the graph as way-points. Levels are drawn by a seeded generator.
    """

    def __init__(self, metric: str = "cosine", m: int = 16, ef_construction: int = 200, seed: int = 42):
        if m < 2 or ef_construction < 1:
            raise ValidationError("m must be at least 2 and ef_construction positive")
        self.metric, self.m, self.ef, self._seed = check_metric(metric), m, ef_construction, seed
        self.clear()

    def clear(self) -> None:
        self._draw = generator(self._seed)
        self.ids: list[str] = []
        self.meta: list = []
        self.links: list[list[set[int]]] = []
        self.dead: list[bool] = []
        self.at: dict[str, int] = {}
        self.entry, self.dim = -1, 0
        self._v = np.zeros((0, 0))
        self._norm = np.zeros(0)

    def __len__(self) -> int:
        return len(self.at)

    def _distance(self, q: np.ndarray, rows: list[int]) -> np.ndarray:
        v = self._v[rows]
        if self.metric == "euclidean":
            return np.sqrt(((v - q) ** 2).sum(1))
        if self.metric == "manhattan":
            return np.abs(v - q).sum(1)
        product = v @ q
        if self.metric == "dot":
            return 1 - product
        norms = self._norm[rows] * np.sqrt(q @ q)
        return 1 - np.divide(product, norms, out=np.zeros_like(product), where=norms != 0)

    def _score(self, d: float) -> float:
        return 1 - d if self.metric in ("cosine", "dot") else 1 / (1 + d)

    def _beam(self, q: np.ndarray, start: list[tuple[float, int]], layer: int, ef: int) -> list[tuple[float, int]]:
        """The ``ef`` nearest (distance, node) that are found from ``start``, nearest first."""
        seen = {n for _, n in start}
        ahead, kept = list(start), [(-d, -n) for d, n in start]
        heapify(ahead)
        heapify(kept)
        while ahead:
            d, n = heappop(ahead)
            if len(kept) >= ef and d > -kept[0][0]:
                break
            new = [x for x in self.links[n][layer] if x not in seen]
            if not new:
                continue
            seen.update(new)
            for x, dx in zip(new, self._distance(q, new).tolist()):
                if len(kept) < ef or dx < -kept[0][0]:
                    heappush(ahead, (dx, x))
                    heappush(kept, (-dx, -x))
                    if len(kept) > ef:
                        heappop(kept)
        return sorted((-d, -n) for d, n in kept)

    def _descend(self, q: np.ndarray, to: int) -> list[tuple[float, int]]:
        here = [(float(self._distance(q, [self.entry])[0]), self.entry)]
        for layer in range(len(self.links[self.entry]) - 1, to, -1):
            here = self._beam(q, here, layer, 1)[:1]
        return here

    def add(self, key: str, vector, metadata=None) -> None:
        q = np.asarray(vector, np.float32).astype(np.float64)
        if self.dim and len(q) != self.dim:
            raise DimensionMismatchError(f"the index has {self.dim} dimensions, the vector {len(q)}")
        self.remove(key)
        node, self.dim = len(self.ids), len(q)
        if node >= len(self._v):
            grown = np.zeros((max(64, 2 * node), self.dim))
            if node:
                grown[:node] = self._v[:node]
            self._v, self._norm = grown, np.append(self._norm, np.zeros(len(grown) - len(self._norm)))
        self._v[node], self._norm[node] = q, np.sqrt(q @ q)
        level = floor(-log(self._draw() or 2**-32) / log(self.m))
        self.ids.append(key)
        self.meta.append(metadata)
        self.dead.append(False)
        self.links.append([set() for _ in range(level + 1)])
        self.at[key] = node
        if self.entry < 0:
            self.entry = node
            return
        top = len(self.links[self.entry]) - 1
        here = self._descend(q, min(level, top))
        for layer in range(min(level, top), -1, -1):
            here = self._beam(q, here, layer, self.ef)
            cap = 2 * self.m if layer == 0 else self.m
            for _, x in here[: self.m]:
                self.links[node][layer].add(x)
                self.links[x][layer].add(node)
                if len(self.links[x][layer]) > cap:
                    near = sorted(self.links[x][layer])
                    order = np.argsort(self._distance(self._v[x], near), kind="stable")
                    for far in order[cap:]:
                        self.links[x][layer].discard(near[far])
                        self.links[near[far]][layer].discard(x)
        if level > top:
            self.entry = node

    def add_batch(self, items) -> None:
        """Adds (id, vector, metadata or none). Many at a time find their neighbours by products with all
        earlier nodes, as a beam without a limit would; few are added one by one."""
        items = list(items)
        if len(items) < BULK_ROWS or self.metric == "manhattan":
            for item in items:
                self.add(*item)
            return
        last = {key: i for i, (key, *_) in enumerate(items)}
        items = [x for i, x in enumerate(items) if last[x[0]] == i]
        new = np.stack([np.asarray(v, np.float32).astype(np.float64) for _, v, *_ in items])
        if self.dim and new.shape[1] != self.dim:
            raise DimensionMismatchError(f"the index has {self.dim} dimensions, the vectors {new.shape[1]}")
        for key, *_ in items:
            self.remove(key)
        before, self.dim = len(self.ids), new.shape[1]
        total = before + len(new)
        v = np.concatenate([self._v[:before].reshape(before, self.dim), new])
        self._v, self._norm = v, np.sqrt((v * v).sum(1))
        near: list[list[dict[int, float]]] = [[dict(zip(own, self._distance(v[n], own).tolist())) if (own := sorted(x)) else {} for x in layers] for n, layers in enumerate(self.links)]
        levels = [len(x) - 1 for x in self.links] + [floor(-log(self._draw() or 2**-32) / log(self.m)) for _ in new]
        for (key, _, *meta), n in zip(items, range(before, total)):
            self.ids.append(key)
            self.meta.append(meta[0] if meta else None)
            self.dead.append(False)
            self.at[key] = n
            near.append([{} for _ in range(levels[n] + 1)])
        level = np.array(levels)
        for layer in range(level.max() + 1):
            cap = 2 * self.m if layer == 0 else self.m
            nodes = np.flatnonzero(level >= layer)
            for start in range(int(np.searchsorted(nodes, before)), len(nodes), 512):
                rows = nodes[start : start + 512]
                earlier = nodes[: start + len(rows)]
                d = self._distances(v[rows], v[earlier])
                d[earlier[None] >= rows[:, None]] = np.inf
                k = min(self.m, len(earlier))
                best = np.argpartition(d, k - 1, axis=1)[:, :k]
                for n, own, far in zip(rows.tolist(), earlier[best].tolist(), np.take_along_axis(d, best, 1).tolist()):
                    for dx, x in sorted(zip(far, own)):
                        if dx == np.inf:
                            break
                        near[n][layer][x] = near[x][layer][n] = dx
                        if len(near[x][layer]) > cap:
                            out = max(near[x][layer].items(), key=lambda e: (e[1], e[0]))[0]
                            del near[x][layer][out]
                            near[out][layer].pop(x, None)
        self.links = [[set(x) for x in layers] for layers in near]
        top = len(self.links[self.entry]) - 1 if self.entry >= 0 else -1
        for n in range(before, total):
            if levels[n] > top:
                self.entry, top = n, levels[n]

    def _distances(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Distances of all rows of a to all rows of b."""
        s = blocks.scores(a, b, self.metric)
        return 1 - s if self.metric in ("cosine", "dot") else 1 / s - 1

    def _pair_distances(self, q: np.ndarray, norms: np.ndarray, row: np.ndarray, node: np.ndarray) -> np.ndarray:
        a, b = q[row], self._v[node]
        if self.metric == "euclidean":
            return np.sqrt(((a - b) ** 2).sum(1))
        if self.metric == "manhattan":
            return np.abs(a - b).sum(1)
        product = np.einsum("ij,ij->i", a, b)
        if self.metric == "dot":
            return 1 - product
        both = norms[row] * self._norm[node]
        return 1 - np.divide(product, both, out=np.zeros_like(product), where=both != 0)

    def search_batch(self, vectors: np.ndarray, k: int = 10, ef: int = 50, keep=None) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, distances), k columns for each query, -1 and inf where there are fewer.

        All queries take the same steps. They begin at the nearest nodes of the upper layers, which are found
        by a product, so that groups without links to the rest are entered too.
        """
        if k < 1:
            raise ValidationError("k must be positive")
        q, ef, n = np.ascontiguousarray(vectors, np.float64), max(ef, k), len(self.ids)
        if not self.at or not len(q):
            return np.full((len(q), k), -1), np.full((len(q), k), np.inf)
        if q.shape[1] != self.dim:
            raise DimensionMismatchError(f"the index has {self.dim} dimensions, the queries {q.shape[1]}")
        width = max(1, max(len(x[0]) for x in self.links))
        links = np.full((n, width), -1, np.int32)
        for i, x in enumerate(self.links):
            links[i, : len(x[0])] = sorted(x[0])
        upper = np.array([i for i, x in enumerate(self.links) if len(x) > 1] or [self.entry])
        norms = np.sqrt((q * q).sum(1))
        out_n, out_d = np.full((len(q), k), -1), np.full((len(q), k), np.inf)
        stay = ~np.array(self.dead)
        if keep is not None:
            stay &= np.array([keep(key, meta) for key, meta in zip(self.ids, self.meta)], bool)
        for at in range(0, len(q), 512):
            own, own_norms = q[at : at + 512], norms[at : at + 512]
            m = len(own)
            seen, stamp = np.zeros((m, n), bool), np.zeros((m, n), np.int16)
            far = self._distances(own, self._v[upper])
            starts = min(len(upper), max(8, ef // 4))
            pick = np.argpartition(far, starts - 1, axis=1)[:, :starts]
            d, node, open_ = np.full((m, ef), np.inf), np.full((m, ef), -1), np.zeros((m, ef), bool)
            starts = min(starts, ef)
            pick = np.take_along_axis(pick, np.argsort(np.take_along_axis(far, pick, 1), axis=1, kind="stable"), 1)[:, :starts]
            d[:, :starts], node[:, :starts], open_[:, :starts] = np.take_along_axis(far, pick, 1), upper[pick], True
            seen[np.arange(m)[:, None], upper[pick]] = True
            live = np.arange(m)
            while len(live):
                ahead = np.argsort(~open_[live], axis=1, kind="stable")[:, :AHEAD]
                real = np.take_along_axis(open_[live], ahead, 1)
                from_ = np.where(real, np.take_along_axis(node[live], ahead, 1), 0)
                open_[live[:, None], ahead] = False
                next_ = np.where(real[:, :, None], links[from_], -1).reshape(len(live), -1)
                row, col = np.nonzero(next_ >= 0)
                x = next_[row, col]
                fresh = ~seen[live[row], x]
                row, col, x = row[fresh], col[fresh], x[fresh]
                stamp[live[row], x] = col
                first = stamp[live[row], x] == col  # a node that two of the followed ones lead to counts once
                row, col, x = row[first], col[first], x[first]
                seen[live[row], x] = True
                new_d, new_n = np.full(next_.shape, np.inf), np.full(next_.shape, -1)
                new_d[row, col], new_n[row, col] = self._pair_distances(own, own_norms, live[row], x), x
                all_d = np.concatenate([d[live], new_d], axis=1)
                all_n = np.concatenate([node[live], new_n], axis=1)
                all_o = np.concatenate([open_[live], new_n >= 0], axis=1)
                best = np.argpartition(all_d, ef - 1, axis=1)[:, :ef]
                best = np.take_along_axis(best, np.argsort(np.take_along_axis(all_d, best, 1), axis=1, kind="stable"), 1)
                d[live], node[live], open_[live] = (np.take_along_axis(y, best, 1) for y in (all_d, all_n, all_o))
                open_[live] &= node[live] >= 0
                live = live[open_[live].any(1)]
            good = (node >= 0) & stay[node]
            order = np.argsort(~good, axis=1, kind="stable")[:, :k]
            kept = np.take_along_axis(good, order, 1)
            out_n[at : at + m, : order.shape[1]] = np.where(kept, np.take_along_axis(node, order, 1), -1)
            out_d[at : at + m, : order.shape[1]] = np.where(kept, np.take_along_axis(d, order, 1), np.inf)
        return out_n, out_d

    def verified(self, vectors: np.ndarray, found: np.ndarray, k: int, order: np.ndarray, keep=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, node, distance) of exactly the k nearest, given the distances that ``search_batch`` found.

        The last distance found bounds the answer, and a product with all items shows what the graph missed.
        Scores are compared when rounded to 9 digits, then by ``order``, a value of each node.
        """
        q, out = np.ascontiguousarray(vectors, np.float64), []
        stay = ~np.array(self.dead, bool)
        if keep is not None:
            stay &= np.array([keep(key, meta) for key, meta in zip(self.ids, self.meta)], bool)
        nodes = np.flatnonzero(stay)
        place = np.argsort(np.argsort(order[nodes], kind="stable"), kind="stable")
        rows = max(1, (4 << 20) // max(1, len(nodes)))
        for at in range(0, len(q) if len(nodes) else 0, rows):
            own = q[at : at + rows]
            s = blocks.scores(own, self._v[nodes], self.metric)
            last = found[at : at + rows, -1]
            bound = (1 - last if self.metric in ("cosine", "dot") else 1 / (1 + last)) - 1e-8
            row, col = np.nonzero(s >= np.where(np.isfinite(last), bound, -np.inf)[:, None])
            by = np.lexsort((place[col], -np.round(s[row, col], 9), row))
            row, col = row[by], col[by]
            first = np.arange(len(row)) - np.searchsorted(row, row) < k
            row, col = row[first], col[first]
            d = 1 - s[row, col] if self.metric in ("cosine", "dot") else 1 / s[row, col] - 1
            out.append((row + at, nodes[col], d))
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        return tuple(np.concatenate(x) for x in zip(*out))

    def get(self, key: str):
        n = self.at.get(key)
        return None if n is None else (key, self._v[n].astype(np.float32), self.meta[n])

    def remove(self, key: str) -> bool:
        n = self.at.pop(key, None)
        if n is None:
            return False
        self.dead[n] = True
        if n == self.entry and self.at:
            self.entry = max(self.at.values(), key=lambda x: (len(self.links[x]), -x))
        elif not self.at:
            self.clear()
        return True

    def search(self, vector, k: int = 10, ef: int = 50, keep=None) -> list[tuple[str, float]]:
        """(id, score) of the nearest items, best first; ``keep(id, metadata)`` is asked after the search."""
        if k < 1:
            raise ValidationError("k must be positive")
        if not self.at:
            return []
        q = np.asarray(vector, np.float64)
        if len(q) != self.dim:
            raise DimensionMismatchError(f"the index has {self.dim} dimensions, the query {len(q)}")
        found = self._beam(q, self._descend(q, 0), 0, max(ef, k))
        good = [(self.ids[n], self._score(d)) for d, n in found if not self.dead[n] and (keep is None or keep(self.ids[n], self.meta[n]))]
        return good[:k]

    def to_bytes(self) -> bytes:
        """Version byte, header length and JSON header, then the live nodes: id, metadata, vector, level, links."""
        live = [n for n, dead in enumerate(self.dead) if not dead]
        number = {n: i for i, n in enumerate(live)}
        head = {"metric": self.metric, "M": self.m, "efConstruction": self.ef, "dimensions": self.dim, "nodeCount": len(live), "maxLevel": max((len(self.links[n]) - 1 for n in live), default=-1), "entryPoint": number.get(self.entry, -1)}
        text = json.dumps(head).encode()
        out = [struct.pack("<BI", 1, len(text)), text]
        for n in live:
            key, meta, vector = self.ids[n].encode(), b"" if self.meta[n] is None else json.dumps(self.meta[n]).encode(), self._v[n].astype("<f4").tobytes()
            out += [struct.pack("<I", len(key)), key, struct.pack("<I", len(meta)), meta, struct.pack("<I", len(vector)), vector, struct.pack("<II", len(self.links[n]) - 1, len(self.links[n]))]
            for layer, near in enumerate(self.links[n]):
                kept = sorted(number[x] for x in near if x in number)
                out.append(struct.pack(f"<II{len(kept)}I", layer, len(kept), *kept))
        return b"".join(out)

    @classmethod
    def from_bytes(cls, data: bytes) -> HnswIndex:
        at = 0

        def take(n: int) -> bytes:
            nonlocal at
            if at + n > len(data):
                raise ValidationError("the index's bytes end too early")
            at += n
            return data[at - n : at]

        number = lambda: struct.unpack("<I", take(4))[0]
        if take(1) != b"\x01":
            raise ValidationError("unknown version of an index")
        try:
            head = json.loads(take(number()))
        except ValueError as e:
            raise ValidationError("the index's header isn't JSON") from e
        out = cls(head["metric"], head["M"], head["efConstruction"])
        out.dim = head["dimensions"]
        vectors = []
        for n in range(head["nodeCount"]):
            key = take(number()).decode()
            meta = take(number())
            vectors.append(np.frombuffer(take(number()), "<f4"))
            number()
            layers = []
            for _ in range(number()):
                number()
                size = number()
                layers.append(set(struct.unpack(f"<{size}I", take(4 * size))))
            if any(x >= head["nodeCount"] for near in layers for x in near):
                raise ValidationError("a link of the index leads nowhere")
            out.ids.append(key)
            out.meta.append(json.loads(meta) if meta else None)
            out.dead.append(False)
            out.links.append(layers)
            out.at[key] = n
        if vectors:
            out._v = np.stack(vectors).astype(np.float64)
            out._norm = np.sqrt((out._v**2).sum(1))
        out.entry = head["entryPoint"]
        return out


def _items(rows: DataFrame, key: str, vector: str, metadata: str | None) -> DataFrame:
    meta = F.to_json(F.col(metadata)) if metadata else F.lit(None).cast("string")
    return rows.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("string").alias("id"), F.col(vector).cast("array<float>").alias("v"), meta.alias("meta"))


def _shard(shards: int):
    return F.pmod(F.xxhash64("id"), F.lit(shards))


def _of_frame(pdf: pd.DataFrame) -> list[tuple]:
    return [(key, v, json.loads(m) if isinstance(m, str) else None) for key, v, m in pdf.sort_values("id")[["id", "v", "meta"]].itertuples(index=False)]


_SHARD = "shard bigint, shards bigint, n bigint, index binary"


def build(corpus: DataFrame, metric: str = "cosine", m: int = 16, ef_construction: int = 200, seed: int = 42, key: str = "vec_id", vector: str = "embedding", shard_rows: int = SHARD_ROWS, metadata: str | None = None) -> DataFrame:
    """(shard, shards, n, index): rows are spread over shards by the hash of their key, with the column ``metadata`` (a map or struct).

    Null keys and vectors are left out; of rows that share a key one is taken.
    """
    rows = _items(corpus, key, vector, metadata)
    shards = max(1, -(-rows.count() // shard_rows))

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        index = HnswIndex(metric, m, ef_construction, seed)
        index.add_batch(_of_frame(pdf))
        return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "shards": [shards], "n": [len(index)], "index": [index.to_bytes()]})

    return rows.withColumn("shard", _shard(shards)).groupBy("shard").applyInPandas(make, _SHARD)


def update(index: DataFrame, add: DataFrame | None = None, remove: DataFrame | None = None, key: str = "vec_id", vector: str = "embedding", metadata: str | None = None) -> DataFrame:
    """The index with the rows of ``add`` (a known key is replaced) and without the keys of ``remove``; only shards are rewritten."""
    shards = index.agg(F.max("shards")).first()[0]
    if not shards:
        raise ValidationError("the index has no shard")
    none = index.sparkSession.createDataFrame([], "id string, v array<float>, meta string")
    new = (_items(add, key, vector, metadata) if add is not None else none).withColumn("gone", F.lit(False))
    if remove is not None:
        new = new.unionByName(remove.select(F.col(key).cast("string").alias("id"), F.lit(None).cast("array<float>").alias("v"), F.lit(None).cast("string").alias("meta"), F.lit(True).alias("gone")))

    def change(old: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(old):  # the shard had no row yet
            return pd.DataFrame({"shard": [], "shards": [], "n": [], "index": []}) if rows["gone"].all() else make_first(rows)
        own = HnswIndex.from_bytes(old["index"].iloc[0])
        for x in rows.loc[rows["gone"], "id"]:
            own.remove(x)
        own.add_batch(_of_frame(rows[~rows["gone"]]))
        return old[["shard", "shards"]].assign(n=[len(own)], index=[own.to_bytes()])

    head = index.select("index").first()
    model = HnswIndex.from_bytes(head[0])

    def make_first(rows: pd.DataFrame) -> pd.DataFrame:
        own = HnswIndex(model_metric, model_m, model_ef)
        own.add_batch(_of_frame(rows[~rows["gone"]]))
        return pd.DataFrame({"shard": [rows["shard"].iloc[0]], "shards": [shards], "n": [len(own)], "index": [own.to_bytes()]})

    model_metric, model_m, model_ef = model.metric, model.m, model.ef
    return index.groupBy("shard").cogroup(new.withColumn("shard", _shard(shards)).groupBy("shard")).applyInPandas(change, _SHARD)


def search(index: DataFrame, queries: DataFrame, k: int = 10, ef: int = 100, query_key: str = "query_id", vector: str = "embedding", keep: Callable[[str, object], bool] | None = None, with_metadata: bool = False, id_type: str = "bigint", exact: bool = False) -> DataFrame:
    """(query_id, rank, id, score and perhaps metadata): about the k nearest items of every query.

    ``keep(id, metadata)`` filters what the search found, as it isn't part of the graph; ``metadata`` is a map.
    A shard is read once for about ``QUERY_ROWS`` queries. ``exact``: the graph's answers are verified by a
    product with the shard's items, so that they are exactly the nearest, ties by id.
    """
    if k < 1:
        raise ValidationError("k must be positive")
    packed = blocks.packed(queries, query_key, vector)
    shards, groups = index.agg(F.coalesce(F.max("shards"), F.lit(1))).first()[0], max(1, -(-packed.rows // QUERY_ROWS))
    all_shards, all_groups = (F.sequence(F.lit(0).cast("bigint"), F.lit(x - 1).cast("bigint")) for x in (shards, groups))
    asked = packed.table.select(F.explode(all_shards).alias("shard"), F.pmod("strip", F.lit(groups)).alias("group"), "ids", "flat")
    there = index.select("shard", F.explode(all_groups).alias("group"), "index")
    kind = pa.schema([("query_id", pa.int64()), ("id", pa.string()), ("score", pa.float64()), ("metadata", pa.string())])

    def ask(shard: pa.Table, rows: pa.Table) -> pa.Table:
        if not len(shard) or not len(rows):
            return kind.empty_table()
        own = HnswIndex.from_bytes(shard.column("index")[0].as_py())
        ids = [x.values.to_numpy() for x in rows.column("ids")]
        q = np.concatenate([blocks.matrix(x, len(i)) for x, i in zip(rows.column("flat"), ids)])
        node, d = own.search_batch(q, k, ef, keep)
        if exact:
            ids_of = np.array(own.ids)
            row, hit, s = own.verified(q, d, k, ids_of if id_type == "string" else ids_of.astype(np.int64), keep)
        else:
            row, col = np.nonzero(node >= 0)
            hit, s = node[row, col], d[row, col]
        s = 1 - s if own.metric in ("cosine", "dot") else 1 / (1 + s)
        meta = [json.dumps(own.meta[n]) if with_metadata and own.meta[n] is not None else None for n in hit.tolist()]
        return pa.table({"query_id": np.concatenate(ids)[row], "id": pa.array([own.ids[n] for n in hit.tolist()], pa.string()), "score": s, "metadata": pa.array(meta, pa.string())})

    found = there.groupBy("shard", "group").cogroup(asked.groupBy("shard", "group")).applyInArrow(ask, "query_id bigint, id string, score double, metadata string")
    found = found.select("query_id", F.col("id").cast(id_type).alias("id"), "score", F.from_json("metadata", "map<string,string>").alias("metadata"))
    return _ranked(found, k).select("query_id", "rank", "id", "score", *(["metadata"] if with_metadata else []))
