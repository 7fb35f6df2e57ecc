"""Quality of clusterings: rows (cluster_id, vec_id, embedding), any number of clusters."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodevec.functions.vector import check_metric, distance, score
from lodevec.operators import blocks
from lodevec.operators.aggregate import average
from lodevec.runtime import broadcast_if_small, materialise


def centroids(members: DataFrame, vector: str = "embedding") -> DataFrame:
    """(cluster_id, centroid, size)."""
    return average(members, ["cluster_id"], vector).select("cluster_id", F.col(vector).alias("centroid"), F.col("count").alias("size"))


def _to_centroid(members: DataFrame, metric: str, vector: str, given: DataFrame | None = None) -> DataFrame:
    check_metric(metric)
    means = given if given is not None else centroids(members, vector)
    both = members.join(means.select("cluster_id", "centroid"), "cluster_id")
    return both.withColumn("similarity", score(vector, "centroid", metric)).withColumn("distance", distance(vector, "centroid", metric))


def cohesion(members: DataFrame, metric: str = "cosine", vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(cluster_id, size, cohesion): mean score over the pairs of a cluster; 1 for a single member.

    For cosine and dot the sum over the pairs follows from the sum of the (unit) vectors, in one pass;
    the other metrics compare the pairs of a cluster by tiles, each of which gives one sum a cluster.
    """
    check_metric(metric)
    sizes = members.groupBy("cluster_id").agg(F.count("*").alias("size"))
    if metric in ("cosine", "dot"):
        v = F.col(vector).cast("array<double>")
        norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
        rows = members.select("cluster_id", F.posexplode(F.transform(v, lambda x: F.coalesce(F.try_divide(x, norm), F.lit(0.0))) if metric == "cosine" else v).alias("pos", "x"))
        by_pos = rows.groupBy("cluster_id", "pos").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
        pairs = by_pos.groupBy("cluster_id").agg((F.sum(F.col("s") * F.col("s") - F.col("q")) / 2).alias("total"))
    else:
        pairs = _own_sums(members, metric, vector, key)
    n = F.col("size")
    return sizes.join(pairs, "cluster_id", "left").select("cluster_id", "size", F.when(n <= 1, 1.0).otherwise(F.try_divide("total", n * (n - 1) / 2)).alias("cohesion"))


def _numbered(members: DataFrame, vector: str, key: str) -> tuple[DataFrame, DataFrame]:
    """(cluster_id, number) of the clusters and the rows (id, v), whose vectors begin with their cluster's number."""
    number = F.dense_rank().over(Window.orderBy("cluster_id")) - 1
    names = members.select("cluster_id").distinct().withColumn("number", number)
    rows = members.join(broadcast_if_small(names, names.count(), 64), "cluster_id").select(F.col(key).alias("id"), F.col("number").cast("double").alias("c"), F.col(vector).cast("array<double>").alias("v"))
    return names, rows.select("id", F.concat(F.array("c"), "v").alias("v"))


def _own_sums(members: DataFrame, metric: str, vector: str, key: str, rows: int = 512, columns: int = 1024) -> DataFrame:
    """(cluster_id, total): the sum of the scores of each cluster's pairs of rows; only pairs within clusters are compared."""
    names, tagged = _numbered(members, vector, key)

    def of_cluster(ids, v, other, w, same):
        total = 0.0
        repeated = not same and len(np.intersect1d(ids, other)) or same and len(np.unique(ids)) < len(ids)
        for i in range(0, len(v), rows):
            for j in range(i // columns * columns if same else 0, len(w), columns):
                s = blocks.scores(v[i : i + rows], w[j : j + columns], metric)
                if same and j < i + rows:
                    s[np.arange(i, i + len(s))[:, None] >= np.arange(j, j + s.shape[1])[None]] = 0
                if repeated:
                    s[ids[i : i + rows, None] == other[None, j : j + columns]] = 0
                total += s.sum()
        return total

    def work(ids, v, other, w, same):
        sides = []
        for x, m in ((ids, v), (other, w)):
            c = m[:, 0].astype(np.int64)
            order = np.argsort(c, kind="stable")
            present, first = np.unique(c[order], return_index=True)
            sides.append({k: (x[own], m[own, 1:]) for k, own in zip(present.tolist(), np.split(order, first[1:]))})
        both = [k for k in sides[0] if k in sides[1]]
        return np.array(both, np.int64), np.array([of_cluster(*sides[0][k], *sides[1][k], same) for k in both], float)

    sums = blocks.per_tile(blocks.packed(tagged, "id", "v"), work, "number bigint, part double", ["number", "part"]).groupBy("number").agg(F.sum("part").alias("total"))
    return sums.join(broadcast_if_small(names, names.count(), 64).select("cluster_id", F.col("number").cast("bigint").alias("number")), "number").select("cluster_id", "total")


def _pair_sums(members: DataFrame, metric: str, vector: str, key: str, distances: bool) -> DataFrame:
    """(id, a_cluster, b_cluster, total): for each row the sum of its scores or distances to the other rows of each cluster."""
    names, tagged = _numbered(members, vector, key)

    def sums(ids, ca, cb, s):
        order = np.argsort(cb, kind="stable")
        present, first = np.unique(cb[order], return_index=True)
        part = np.add.reduceat(s[:, order], first, axis=1)
        return np.repeat(ids, len(present)), np.repeat(ca, len(present)), np.tile(present, len(ids)), part.ravel()

    def work(ids, a, other, b, same):
        ca, cb = a[:, 0].astype(np.int64), b[:, 0].astype(np.int64)
        s = blocks.scores(a[:, 1:], b[:, 1:], metric)
        if distances:
            s = 1 - s if metric in ("cosine", "dot") else 1 / s - 1
        s[ids[:, None] == other[None]] = 0
        one = sums(ids, ca, cb, s)
        return one if same else tuple(np.concatenate(x) for x in zip(one, sums(other, cb, ca, s.T)))

    parts = blocks.per_pair(blocks.packed(tagged, "id", "v"), None, work, "id bigint, a bigint, b bigint, part double", ["id", "a", "b", "part"])
    totals = parts.groupBy("id", "a", "b").agg(F.sum("part").alias("total"))
    name = broadcast_if_small(names, names.count(), 64)
    one = name.select(F.col("number").cast("bigint").alias("a"), F.col("cluster_id").alias("a_cluster"))
    two = name.select(F.col("number").cast("bigint").alias("b"), F.col("cluster_id").alias("b_cluster"))
    return totals.join(one, "a").join(two, "b").select("id", "a_cluster", "b_cluster", "total")


def _silhouettes(sums: DataFrame, sizes: DataFrame, by: list[str]) -> DataFrame:
    """(by, silhouette) from sums of distances (by, id, a_cluster, b_cluster, total) and sizes (by, cluster_id, n)."""
    sums = sums.join(sizes.withColumnRenamed("cluster_id", "b_cluster"), [*by, "b_cluster"])
    own = F.col("a_cluster") == F.col("b_cluster")
    per = sums.groupBy(*by, "id").agg(
        F.max(F.when(own, F.when(F.col("n") > 1, F.col("total") / (F.col("n") - 1)).otherwise(0.0))).alias("a"),
        F.min(F.when(~own, F.col("total") / F.col("n"))).alias("b"),
    )
    value = F.when(F.col("b").isNull(), 0.0).otherwise(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    return per.groupBy(*by).agg(F.coalesce(F.avg(value), F.lit(0.0)).alias("silhouette"))


def silhouette(members: DataFrame, metric: str = "cosine", vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """One row (silhouette): the mean of (b - a) / max(a, b); a member alone has a = 0; 0 for at most one cluster."""
    check_metric(metric)
    sizes = members.groupBy("cluster_id").agg(F.count("*").alias("n"))
    return _silhouettes(_pair_sums(members, metric, vector, key, True), sizes, [])


def nested_silhouettes(members: DataFrame, metric: str = "cosine", vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(pos, silhouette) of the clusterings ``cluster_ids[pos]`` of each row, from one pass over all pairs.

    The clusters of each are unions of clusters of the last, so that sums over the last one's clusters add up.
    """
    check_metric(metric)
    fine = members.withColumn("cluster_id", F.element_at("cluster_ids", -1))
    names = materialise(fine.select("cluster_id", F.posexplode("cluster_ids").alias("pos", "c")).groupBy("cluster_id", "pos", "c").agg(F.count("*").alias("n")), "nested-clusters")
    a = names.select(F.col("cluster_id").alias("a_fine"), "pos", F.col("c").alias("a_cluster"))
    b = names.select(F.col("cluster_id").alias("b_fine"), "pos", F.col("c").alias("b_cluster"))
    sums = _pair_sums(fine, metric, vector, key, True).withColumnsRenamed({"a_cluster": "a_fine", "b_cluster": "b_fine"})
    sums = sums.join(a, "a_fine").join(b, ["b_fine", "pos"]).groupBy("pos", "id", "a_cluster", "b_cluster").agg(F.sum("total").alias("total"))
    return _silhouettes(sums, names.groupBy("pos", F.col("c").alias("cluster_id")).agg(F.sum("n").alias("n")), ["pos"])


def centroid_cohesion(members: DataFrame, metric: str = "cosine", vector: str = "embedding") -> DataFrame:
    """(cluster_id, centroid_cohesion): mean score to the centroid; 1 for a single member."""
    near = _to_centroid(members, metric, vector)
    return near.groupBy("cluster_id").agg(F.when(F.count("*") <= 1, 1.0).otherwise(F.avg("similarity")).alias("centroid_cohesion"))


def detect_outliers(members: DataFrame, threshold: float = 2.0, metric: str = "cosine", vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(cluster_id, id, similarity) of members whose similarity is below mean - threshold * deviation (population)."""
    w = Window.partitionBy("cluster_id")
    near = _to_centroid(members, metric, vector).withColumn("__low", F.avg("similarity").over(w) - threshold * F.stddev_pop("similarity").over(w))
    return near.where(F.col("similarity") < F.col("__low")).select("cluster_id", F.col(key).alias("id"), "similarity")


def cluster_stats(members: DataFrame, metric: str = "cosine", vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(cluster_id, size, min, max, mean and median similarity, radius, outliers) of each cluster."""
    near = _to_centroid(members, metric, vector)
    s = F.col("similarity")
    stats = near.groupBy("cluster_id").agg(F.count("*").alias("size"), F.min(s).alias("min_similarity"), F.max(s).alias("max_similarity"), F.avg(s).alias("mean_similarity"), F.expr("percentile(similarity, 0.5)").alias("median_similarity"), F.max("distance").alias("radius"))
    out = detect_outliers(members, 2.0, metric, vector, key).groupBy("cluster_id").agg(F.sort_array(F.collect_list("id")).alias("outliers"))
    kind = out.schema["outliers"].dataType.simpleString()
    return stats.join(out, "cluster_id", "left").withColumn("outliers", F.coalesce("outliers", F.array().cast(kind)))


def centroid_drift(old: DataFrame, new: DataFrame, metric: str = "cosine") -> DataFrame:
    """(cluster_id, drift): distance between the centroids of two snapshots (cluster_id, centroid)."""
    return old.select("cluster_id", F.col("centroid").alias("__a")).join(new.select("cluster_id", F.col("centroid").alias("__b")), "cluster_id").select("cluster_id", distance("__a", "__b", metric).alias("drift"))


def assign_to_cluster(rows: DataFrame, means: DataFrame, metric: str = "cosine", threshold: float = 0.0, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(id, cluster_id, similarity): the nearest centroid, the least cluster on ties; -1 below the threshold.

    Without clusters every row is in -1 with a similarity of minus infinity. Cluster ids are integers.
    """
    check_metric(metric)

    def nearest(ids, v, names, m, _):
        s = blocks.scores(v, m, metric)
        order = np.lexsort((np.broadcast_to(names, s.shape), -np.round(s, 12)), axis=1)[:, 0]
        return ids, names[order], s[np.arange(len(ids)), order]

    parts = blocks.per_pair(blocks.packed(rows, key, vector), blocks.packed(means, "cluster_id", "centroid"), nearest, "id bigint, cluster_id bigint, similarity double", ["id", "cluster_id", "similarity"])
    best = parts.groupBy("id").agg(F.min_by(F.struct("cluster_id", "similarity"), F.struct(-F.round("similarity", 12), F.col("cluster_id"))).alias("b"))
    if not means.take(1):
        return rows.select(F.col(key).cast("bigint").alias("id"), F.lit(-1).cast("bigint").alias("cluster_id"), F.lit(float("-inf")).alias("similarity"))
    return best.select("id", F.when(F.col("b.similarity") < threshold, -1).otherwise(F.col("b.cluster_id")).cast("bigint").alias("cluster_id"), F.col("b.similarity").alias("similarity"))


def merge_clusters(members: DataFrame, first, second) -> DataFrame:
    """The members of the second cluster become members of the first."""
    return members.withColumn("cluster_id", F.when(F.col("cluster_id") == second, F.lit(first)).otherwise(F.col("cluster_id")))


def within_cluster_distance(members: DataFrame, metric: str = "cosine", vector: str = "embedding") -> DataFrame:
    """One row (total): the sum of the members' distances to their centroids."""
    return _to_centroid(members, metric, vector).agg(F.coalesce(F.sum("distance"), F.lit(0.0)).alias("total"))

