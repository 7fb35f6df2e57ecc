import numpy as np
import pytest
from pyspark.sql import functions as F

from lodevec.errors import ValidationError
from lodevec.operators import aggregate as G
from lodevec.operators import clustering as C
from lodevec.operators import quality as K
from lodevec.queries import QUERIES

AXES = [[1.0, 0.01 * i, 0.0] for i in range(3)] + [[0.0, 1.0, 0.01 * i] for i in range(3)]


def table(spark, vectors, **more):
    rows = [(i, [float(x) for x in v], *(c[i] for c in more.values())) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>" + "".join(f", {n} long" for n in more))


def test_greedy_groups():
    v = np.array(AXES, np.float32)
    assert C.greedy_labels(v, C.GreedyConfig(0.8, 1, 5)).tolist() == [0, 0, 0, 1, 1, 1]
    assert C.greedy_labels(v, C.GreedyConfig(0.8, 1, 1)).tolist() == [0] * 6
    assert C.greedy_labels(v, C.GreedyConfig(0.8, 10, 5)).tolist() == [0] * 6  # nothing is large enough: one cluster of all
    lone = np.array([*AXES[:3], [0.0, 0.0, 1.0]], np.float32)
    assert C.greedy_labels(lone, C.GreedyConfig(0.8, 2, 5)).tolist() == [0] * 4  # the lone row joins the nearest
    shuffled = C.greedy_labels(v, C.GreedyConfig(0.8, 1, 5, shuffle=True))
    assert len(set(shuffled[:3])) == 1 and len(set(shuffled[3:])) == 1 and len(set(shuffled)) == 2
    average = C.greedy_labels(v, C.GreedyConfig(0.8, 1, 5, strategy="average-similarity"))
    assert average.tolist() == [0, 0, 0, 1, 1, 1]
    assert len(C.greedy_labels(np.zeros((0, 3)), C.GreedyConfig())) == 0


def test_parameters_are_checked():
    for bad in ({"max_clusters": 0}, {"min_size": -1}, {"metric": "x"}, {"strategy": "x"}):
        with pytest.raises(ValidationError):
            C.GreedyConfig(**bad)
    with pytest.raises(ValidationError):
        C.preset("x")
    assert (C.preset("balanced").threshold, C.preset("balanced").min_size, C.preset("balanced").max_clusters) == (0.85, 5, 5)


def test_clusters_of_tables(spark):
    df = table(spark, AXES + [[0.0, 0.0, 1.0]]).unionByName(spark.createDataFrame([(None, [1.0, 0.0, 0.0]), (99, None)], "vec_id long, embedding array<float>"))
    got = {r.vec_id: r.cluster_id for r in C.cluster_embeddings(df, C.GreedyConfig(0.8, 1, 9)).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 1, 4: 1, 5: 1, 6: 2}
    assert C.cluster_embeddings(df.limit(0)).count() == 0


def test_online_clusterer():
    own = C.IncrementalClusterer(C.GreedyConfig(0.8, 1, 5))
    assert own.add_batch(np.array(AXES)) == [0, 0, 0, 1, 1, 1]
    assert own.size == 6 and own.stats() == {"clusters": 2, "rows": 6, "average_size": 3.0}
    assert own.clusters()[0][0] == pytest.approx(np.mean(AXES[:3], axis=0), abs=1e-6)
    assert own.rebalance(np.array(AXES)) == [0, 0, 0, 1, 1, 1] and own.size == 6
    again = C.IncrementalClusterer(C.GreedyConfig(0.8, 1, 5))
    again.restore(*own.state())
    assert again.add(AXES[0]) == 0 and again.size == 7 and own.rebalance([]) == [] and own.size == 0 and set(vars(own)) == {"config", "_leader"}


def naive_density(v, size):
    """Clusters of well-separated groups by single linkage at the largest gap."""
    d = C.distances(np.asarray(v, float), "euclidean")
    labels = np.arange(len(v))
    for i, j in zip(*np.nonzero(d < 2)):
        labels[labels == labels[j]] = labels[i]
    return labels


def test_density_finds_blobs_and_noise():
    r = np.random.default_rng(0)
    blobs = np.concatenate([r.normal(c, 0.15, (20, 2)) for c in ((0, 0), (10, 0), (0, 10))])
    far = np.array([[40.0, 40], [-40, 30], [50, -20], [-30, -50]])
    labels = C.density_labels(np.concatenate([blobs, far]), 5)
    assert [len(set(labels[i : i + 20])) for i in (0, 20, 40)] == [1, 1, 1] and len(set(labels[:60])) == 3
    assert min(labels[:60]) >= 0 and set(labels[:60]) == {0, 1, 2}
    truth = naive_density(blobs, 5)
    assert all((truth[i] == truth[j]) == (labels[i] == labels[j]) for i in range(60) for j in range(60))
    assert C.density_labels(blobs[:3], 5).tolist() == [-1] * 3
    assert len(set(C.density_labels(np.zeros((8, 2)), 5))) == 1


def test_spanning_tree_is_least():
    r = np.random.default_rng(4)
    d = C.distances(r.normal(size=(25, 3)), "euclidean")
    tree = C.spanning_tree(d)
    root = list(range(25))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    total = 0.0
    for w, i, j in sorted((d[i, j], i, j) for i in range(25) for j in range(i)):
        if find(i) != find(j):
            root[find(i)] = find(j)
            total += w
    assert len(tree) == 24 and tree[:, 2].sum() == pytest.approx(total) and (np.diff(tree[:, 2]) >= 0).all()


@pytest.mark.parametrize("metric", ["euclidean", "cosine", "manhattan"])
def test_density_without_the_matrix_is_the_same(metric):
    """Against the whole matrix, with groups of equal and of almost equal rows."""
    r = np.random.default_rng(6)
    v = np.concatenate([r.normal(size=(150, 6)), np.repeat(r.normal(size=(4, 6)), 7, 0), 3 + 1e-9 * r.normal(size=(20, 6))])
    d = np.stack([C._distances_from(x, v, np.arange(len(v)), metric) for x in v])
    assert (d == d.T).all() and d == pytest.approx(C.distances(v, metric), abs=2e-7)
    core = np.sort(d + np.diag(np.full(len(v), np.inf)), axis=1)[:, 4]
    assert (C._core(v, 5, metric, 64) == core).all()
    reach = np.maximum(np.maximum(core[:, None], core[None]), d)
    assert (C.spanning_tree(reach) == C._prim(core, lambda node, nodes: C._distances_from(v[node], v, nodes, metric))).all()


def test_density_query_takes_the_whole_table(spark, tmp_path):
    """Two clusters that span the labels; no label alone has enough rows for one."""
    rows = [(i, [10.0 * (i % 2), 0.01 * i], i // 2) for i in range(16)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = QUERIES["cluster_hdbscan"](spark, str(tmp_path))
    assert got.columns == ["vec_id", "cluster_id"]
    got = {r.vec_id: r.cluster_id for r in got.collect()}
    assert got == {i: got[i % 2] for i in range(16)} and set(got.values()) == {0, 1}


def test_density_of_tables(spark):
    df = table(spark, AXES, part=[0, 0, 0, 1, 1, 1])
    assert C.hdbscan(df, 2, by=["part"]).count() == 6
    with pytest.raises(ValidationError):
        C.hdbscan(df, 1)
    core = {r.id: r.core_distance for r in C.core_distances(df, 2).collect()}
    d = np.sort(C.distances(np.array(AXES, np.float32).astype(float), "euclidean"), axis=1)[:, 2]
    assert [core[i] for i in range(6)] == pytest.approx(d, abs=1e-6)


@pytest.fixture(scope="module")
def clusters(spark):
    v = np.random.default_rng(2).normal(size=(24, 5)).astype(np.float32)
    c = [i % 3 for i in range(23)] + [7]
    return v.astype(float), np.array(c), table(spark, v, cluster_id=c)


@pytest.mark.parametrize("metric", ["cosine", "dot", "euclidean", "manhattan"])
def test_quality_by_brute_force(clusters, metric):
    v, c, df = clusters
    from lodevec.operators.blocks import scores

    s = scores(v, v, metric)
    d = C.distances(v, metric)
    if metric == "dot":
        d = 1 - s
    want = {k: (1.0 if (c == k).sum() == 1 else np.mean([s[i, j] for i in np.flatnonzero(c == k) for j in np.flatnonzero(c == k) if i < j])) for k in set(c)}
    got = {r.cluster_id: r.cohesion for r in K.cohesion(df, metric).collect()}
    assert got == pytest.approx(want, abs=1e-6)
    sil = []
    for i in range(len(v)):
        own = [j for j in np.flatnonzero(c == c[i]) if j != i]
        a = np.mean(d[i, own]) if own else 0.0
        b = min(np.mean(d[i, c == k]) for k in set(c) - {c[i]})
        sil.append((b - a) / max(a, b) if max(a, b) else 0.0)
    if metric != "dot":  # negative distances make the measure meaningless
        assert K.silhouette(df, metric).first()[0] == pytest.approx(np.mean(sil), abs=1e-6)


def test_stats_and_outliers(spark):
    v = [[1.0, 0.01 * i] for i in range(9)] + [[-1.0, 0.2]]
    df = table(spark, v, cluster_id=[1] * 10)
    row = K.cluster_stats(df).first()
    assert row.size == 10 and row.outliers == [9] and row.min_similarity < 0 < row.median_similarity
    assert [r.id for r in K.detect_outliers(df).collect()] == [9]
    assert K.cluster_stats(df.limit(0)).count() == 0 and K.silhouette(df).first()[0] == 0
    assert K.centroid_cohesion(table(spark, [[1.0, 2.0]], cluster_id=[5])).first().centroid_cohesion == 1


def test_assignment_and_merging(spark):
    means = spark.createDataFrame([(3, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])], "cluster_id long, centroid array<float>")
    rows = table(spark, [[2.0, 0.0], [0.0, 3.0], [-1.0, -1.0]])
    got = {r.id: r.cluster_id for r in K.assign_to_cluster(rows, means).collect()}
    assert got == {0: 1, 1: 2, 2: -1}
    none = K.assign_to_cluster(rows, means.limit(0)).collect()
    assert {(r.cluster_id, r.similarity) for r in none} == {(-1, float("-inf"))}
    merged = K.merge_clusters(table(spark, AXES, cluster_id=[0, 0, 0, 1, 1, 2]), 0, 1)
    assert {r.cluster_id: r["count"] for r in merged.groupBy("cluster_id").count().collect()} == {0: 5, 2: 1}


def test_optimal_k(spark):
    df = table(spark, [[1.0, 0.01 * i, 0.0] for i in range(4)] + [[-1.0, 0.01 * i, 0.0] for i in range(4)])
    got = C.optimal_k(df, 2, 3).orderBy("k").collect()
    assert [r.k for r in got] == [2, 3] and got[0].chosen and not got[1].chosen and got[0].silhouette > 0.9
    for bad in ({"min_k": 1}, {"method": "x"}):
        with pytest.raises(ValidationError):
            C.optimal_k(df, **bad)


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_optimal_k_measures_each_clustering(spark, metric):
    v = np.random.default_rng(8).normal(size=(60, 12)).astype(np.float32)
    df = table(spark, v)
    got = {r.k: (r.silhouette, r.within) for r in C.optimal_k(df, 2, 6, metric).collect()}
    for k in range(2, 7):
        labels = C.greedy_labels(v.astype(float), C.GreedyConfig(0.0, 1, k, metric))
        members = table(spark, v, cluster_id=labels.tolist())
        assert got[k] == pytest.approx((K.silhouette(members, metric).first()[0], K.within_cluster_distance(members, metric).first()[0]), abs=1e-9)
    assert set(got) == set(range(2, 7))


def test_optimal_k_query_takes_the_default_range(spark, tmp_path):
    """Five groups at the corners of a simplex: the best k is above 4."""
    corners = np.eye(5) - 0.2
    rows = [(i, (corners[i % 5] + 0.001 * np.eye(5)[i // 5]).tolist()) for i in range(25)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = QUERIES["optimal_k"](spark, str(tmp_path)).collect()
    assert [r.k for r in got] == list(range(2, 11)) and [r.k for r in got if r.chosen] == [5]


def test_pooling(spark):
    df = spark.createDataFrame([("a", [1.0, 4.0], 1.0), ("a", [3.0, 0.0], 3.0), ("b", [5.0, 5.0], 0.0), ("c", None, 1.0), (None, [1.0, 1.0], None)], "g string, embedding array<float>, w double")
    got = lambda out: {r.g: r.embedding for r in out.collect()}
    assert got(G.average(df, ["g"])) == {"a": [2, 2], "b": [5, 5], None: [1, 1]}
    assert got(G.max_pool(df, ["g"]))["a"] == [3, 4] and got(G.min_pool(df, ["g"]))["a"] == [1, 0]
    w = got(G.weighted_average(df, "w", ["g"]))
    assert w["a"] == [2.5, 1] and np.isnan(w["b"]).all() and set(w) == {"a", "b"}
    assert G.average(df.limit(0)).count() == 0
    with pytest.raises(Exception, match="differ in length"):
        G.average(spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "embedding array<float>")).collect()


def test_running_means_equal_whole_ones(spark):
    v = np.random.default_rng(3).normal(size=(20, 4)).astype(np.float32)
    df = table(spark, v, g=[i % 2 for i in range(20)])
    first, rest = df.where("vec_id < 7"), df.where("vec_id >= 7")
    got = {r.g: (r.embedding, r["count"]) for r in G.batch_incremental_average(G.average(first, ["g"]), rest, ["g"]).collect()}
    for g in (0, 1):
        assert got[g][0] == pytest.approx(v[g::2].mean(0), abs=1e-5) and got[g][1] == 10
    step = df.where("vec_id = 1").select(G.incremental_average(F.array(*[F.lit(0.0)] * 4), "embedding", 1).alias("m")).first().m
    assert step == pytest.approx(v[1] / 2, abs=1e-6)


@pytest.mark.parametrize("metric", ["euclidean", "cosine", "manhattan"])
def test_density_by_tiles_is_that_of_one_task(spark, monkeypatch, metric):
    """Blobs, noise, copies and a repeated key, in strips of a few rows."""
    from lodevec.operators import blocks

    r = np.random.default_rng(11)
    v = np.concatenate([r.normal(c, 0.4, (40, 4)) for c in (-4, 0, 5)] + [r.normal(0, 6, (40, 4)), np.repeat(r.normal(size=(3, 4)), 9, 0)]).astype(np.float32)[r.permutation(187)]
    df = table(spark, v).repartition(3)
    for name, value in (("BLOCK_ROWS", 7), ("STRIP_ROWS", 40)):
        monkeypatch.setattr(blocks, name, value)
    want = C.density_labels(v.astype(float), 5, None, metric)
    monkeypatch.setattr(C, "DENSITY_ROWS", 20)
    monkeypatch.setattr(C, "density_labels", None)
    got = {x.vec_id: x.cluster_id for x in C.hdbscan(df, 5, None, metric).collect()}
    assert [got[i] for i in range(187)] == want.tolist() and len(set(want.tolist())) > 2
    assert C.hdbscan(df.unionByName(df.where("vec_id < 5")).unionByName(df.limit(1).withColumn("vec_id", F.lit(None).cast("long"))), 5, None, metric).count() == 192
