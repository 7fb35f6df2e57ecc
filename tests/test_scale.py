"""What holds the plans together at size: tiles, bounded rounds, ranks without one task, files that go."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodevec import runtime
from lodevec.errors import ValidationError
from lodevec.functions import flat
from lodevec.operators import blocks
from lodevec.operators import quality as K
from lodevec.operators import search as S


def table(spark, v):
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")


@pytest.fixture
def small(monkeypatch):
    for name, value in (("BLOCK_ROWS", 7), ("STRIP_ROWS", 20), ("RIGHT_ROWS", 30), ("HELD_ROWS", 15)):
        monkeypatch.setattr(blocks, name, value)


@pytest.mark.parametrize("parts", [1, 3])
def test_every_pair_of_blocks_meets_once(spark, small, parts):
    v = np.random.default_rng(0).normal(size=(90, 5)).astype(np.float32)
    df = table(spark, v).repartition(parts)
    packed = blocks.packed(df, "vec_id", "embedding")
    assert packed.rows == 90 and packed.dim == 5
    once = blocks.per_pair(packed, None, lambda a, _, b, __, same: (np.repeat(a, len(b)), np.tile(b, len(a))), "a bigint, b bigint", ["a", "b"])
    pairs = [tuple(r) for r in once.collect()]
    own = {frozenset(p) for p in pairs}
    assert len(own) == 90 * 91 // 2  # every pair, a row with itself too
    both = sum(a != b for a, b in pairs)
    assert both <= 90 * 89 / 2 + 90 * 7  # only a block's own pairs come twice
    every = blocks.per_pair(packed, blocks.packed(df, "vec_id", "embedding"), lambda a, _, b, __, same: (np.repeat(a, len(b)), np.tile(b, len(a))), "a bigint, b bigint", ["a", "b"])
    assert every.count() == 90 * 90 and every.distinct().count() == 90 * 90


def test_searches_by_tiles_have_no_cross_join(spark, small):
    v = np.random.default_rng(1).normal(size=(80, 6)).astype(np.float32)
    df = table(spark, v)
    q = df.where("vec_id % 10 = 0").withColumnRenamed("vec_id", "query_id")
    got = S.top_k_multi(q, df, 9)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "Broadcast" not in plan
    s = blocks.scores(v[::10].astype(float), v.astype(float), "cosine")
    want = np.argsort(-np.round(s, 9), axis=1, kind="stable")[:, :9]
    assert got.toPandas().sort_values(["query_id", "rank"])["id"].to_numpy().reshape(8, 9).tolist() == want.tolist()
    rows = S.similarity_matrix(df, rows=df.where("vec_id % 10 = 0"))
    assert rows.count() == 8 * 80 and S.similarity_matrix(df).count() == 80 * 80
    with pytest.raises(Exception, match="differ in length"):
        blocks.packed(df.withColumn("embedding", F.slice("embedding", 1, (F.col("vec_id") % 2 + 3).cast("int"))), "vec_id", "embedding")


def test_tiles_copy_rows_by_strips():
    """A strip is copied once for each strip of the other side, however many blocks there are."""
    size = lambda n: blocks.Blocks(None, n, -(-n // blocks.BLOCK_ROWS), 64)
    for n in (10_000, 1_000_000, 100_000_000):
        a, _ = blocks.grid(size(n), size(n), 100, True)
        assert a <= max(20, n / blocks.STRIP_ROWS + 1)
    a, b = blocks.grid(size(1000), size(10**9), 100, False)
    assert a == 1 and b >= 10**9 / blocks.RIGHT_ROWS


def test_sums_over_pairs_of_blocks(spark, small):
    r = np.random.default_rng(3)
    v, c = r.normal(size=(60, 4)).astype(np.float32), r.integers(0, 4, 60)
    members = spark.createDataFrame([(i, x.tolist(), int(k)) for i, (x, k) in enumerate(zip(v, c))], "vec_id long, embedding array<float>, cluster_id int")
    d = 1 / blocks.scores(v.astype(float), v.astype(float), "manhattan") - 1
    per = [[d[i][(c == k) & (np.arange(60) != i)].mean() for k in range(4)] for i in range(60)]
    a = np.array([per[i][c[i]] for i in range(60)])
    b = np.array([min(per[i][k] for k in range(4) if k != c[i]) for i in range(60)])
    assert K.silhouette(members, "manhattan").first()[0] == pytest.approx(((b - a) / np.maximum(a, b)).mean())


def greedy(v, t):
    kept = []
    for i in range(len(v)):
        if all(blocks.scores(v[i : i + 1], v[k : k + 1], "cosine")[0, 0] < t for k in kept):
            kept.append(i)
    return kept


def test_chains_are_decided_in_few_rounds(spark, monkeypatch):
    """Chains of near copies, each close to its neighbours alone, by rounds and by components."""
    monkeypatch.setattr(S, "LOCAL_PAIRS", 45)
    monkeypatch.setattr(S, "ROUNDS", 2)
    angle = np.concatenate([np.arange(40) * 0.1, 10 + np.arange(30) * 0.1])
    v = np.zeros((70, 4))
    v[:40, 0], v[:40, 1] = np.cos(angle[:40]), np.sin(angle[:40])
    v[40:, 2], v[40:, 3] = np.cos(angle[40:]), np.sin(angle[40:])
    v = v.astype(np.float32)
    t = np.cos(0.11)
    rounds = []
    monkeypatch.setattr(S, "materialise", lambda df, label: rounds.append(label) or runtime.materialise(df, label))
    assert sorted(r.vec_id for r in S.deduplicate(table(spark, v), t).collect()) == greedy(v.astype(float), t)
    assert rounds.count("removed") <= 4
    monkeypatch.setattr(S, "LOCAL_PAIRS", 5)
    assert sorted(r.vec_id for r in S.deduplicate(table(spark, v[:24]), t).collect()) == greedy(v[:24].astype(float), t)


def test_classes_count_copies_without_listing_pairs(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [0.9, 0.1]), (5, [0.0, 1.0]), (6, [0.0, 0.0]), (7, [0.0, 0.0]), (None, [1.0, 0.0]), (8, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r.vec_id: (r.class_id, r.links) for r in S.similar_classes(df, 0.95).collect()}
    assert got == {1: (1, 3), 2: (1, 3), 3: (1, 3), 4: (1, 3), 5: (5, 0), 6: (6, 0), 7: (7, 0)}
    assert S.similar_classes(df.limit(0), 0.95).count() == 0


def test_ranks_of_a_whole_table(spark):
    df = spark.createDataFrame([(i, (i * 37) % 101) for i in range(300)], "id int, x int").repartition(5)
    got = runtime.ranked(df, [F.col("x").desc(), F.col("id")]).collect()
    want = sorted(((i, (i * 37) % 101) for i in range(300)), key=lambda r: (-r[1], r[0]))
    assert [(r.id, r.x) for r in sorted(got, key=lambda r: r["rank"])] == want and sorted(r["rank"] for r in got) == list(range(1, 301))


def test_written_tables_go(spark):
    path = lambda df: df._scratch.removeprefix("file://")
    one = runtime.materialise(spark.range(3).toDF("x"), "one")
    assert os.path.isdir(path(one)) and one.count() == 3
    runtime.discard(one)
    assert not os.path.exists(path(one))
    runtime.discard(spark.range(1).toDF("x"))
    with runtime.temporary(spark):
        two = runtime.materialise(spark.range(3).toDF("x"), "two")
        assert two.count() == 3
    three = runtime.materialise(spark.range(3).toDF("x"), "three")
    assert not os.path.exists(path(two)) and os.path.isdir(path(three))


def test_flat_arrays_round_trip():
    import pyarrow as pa

    rows = pa.array([[1.0, 2.0], None, [], [3.0]], pa.list_(pa.float32())).slice(1)
    values, sizes, there = flat.flattened(rows)
    assert values.tolist() == [3.0] and sizes.tolist() == [0, 0, 1] and flat.lists(values, sizes, there).to_pylist() == [None, [], [3.0]]
    data, sizes, there = flat.bytes_of(pa.array([b"ab", None, b"", b"c"]).slice(0, 4))
    assert data.tobytes() == b"abc" and flat.binaries(data, sizes, there).to_pylist() == [b"ab", None, b"", b"c"]
    assert flat.places(np.array([5, 1]), np.array([2, 3])).tolist() == [5, 6, 1, 2, 3]


def test_thresholds_are_checked(spark):
    with pytest.raises(ValidationError):
        S.deduplicate(table(spark, np.ones((2, 2))), float("inf"))


@pytest.mark.parametrize("metric,threshold", [("cosine", 0.6), ("euclidean", 0.4), ("dot", 3.0)])
def test_tiles_count_links_and_write_a_forest(spark, monkeypatch, metric, threshold):
    """Chains, groups and copies over several strips, by brute force; fewer rows are written than there are pairs."""
    for name, value in (("BLOCK_ROWS", 7), ("STRIP_ROWS", 40)):
        monkeypatch.setattr(blocks, name, value)
    r = np.random.default_rng(12)
    v = np.concatenate([r.normal(size=(90, 4)), np.repeat(r.normal(size=(4, 4)), 5, 0), r.normal(2, 0.2, (80, 4))]).astype(np.float32)
    n, s = len(v), blocks.scores(v.astype(float), v.astype(float), metric)
    near = (s >= threshold) & ~np.eye(n, dtype=bool)
    label = np.arange(n)
    for _ in range(n):
        label = np.minimum(label, np.where(near, label[None], n).min(1))
    written = []
    monkeypatch.setattr(S, "materialise", lambda df, name: written.append((name, x := runtime.materialise(df, name))) or x)
    got = {x.vec_id: (x.class_id, x.links) for x in S.similar_classes(table(spark, v).repartition(3), threshold, metric).collect()}
    assert got == {i: (label[i], near[i].sum()) for i in range(n)}
    rows = dict(written)["similar"]
    assert rows.where("b is not null").count() < near.sum() / 8 and rows.count() < near.sum() / 4


def test_work_of_a_tile_by_small_parts():
    r = np.random.default_rng(13)
    v = np.concatenate([r.integers(1, 4, (60, 1)), r.normal(size=(60, 3))], axis=1)
    near = np.triu(blocks.scores(v[:, 1:], v[:, 1:], "cosine") >= 0.9, 1)
    near |= near.T
    a, b, links = S._links_of_tile(0.9, "cosine", 8, 16)(np.arange(60), v, np.arange(60), v, True)
    of_row = np.array([x is None for x in b.to_pylist()])
    want = near @ v[:, 0]
    assert dict(zip(a[of_row].tolist(), links[of_row].tolist())) == {i: x for i, x in enumerate(want.astype(int).tolist()) if x}


def test_cohesion_compares_within_clusters_alone(spark, small, monkeypatch):
    r = np.random.default_rng(14)
    v, c = r.normal(size=(70, 4)).astype(np.float32), r.integers(0, 5, 70)
    members = spark.createDataFrame([(i, x.tolist(), int(k)) for i, (x, k) in enumerate(zip(v, c))], "vec_id long, embedding array<float>, cluster_id int")
    monkeypatch.setattr(K, "_pair_sums", None)
    s = 1 / (1 + np.sqrt(((v[:, None].astype(float) - v[None]) ** 2).sum(2)))
    for rows, columns in ((512, 1024), (4, 8)):
        monkeypatch.setattr(K._own_sums, "__defaults__", (rows, columns))
        got = {x.cluster_id: (x.size, x.cohesion) for x in K.cohesion(members.unionByName(members.limit(0)), "euclidean").collect()}
        assert got == {k: ((c == k).sum(), pytest.approx(s[c == k][:, c == k][np.triu_indices((c == k).sum(), 1)].mean())) for k in range(5)}
