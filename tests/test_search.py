import numpy as np
import pytest
from pyspark.sql import functions as F

from lodevec.errors import ValidationError
from lodevec.operators import evaluate as E
from lodevec.operators import search as S
from lodevec.operators.blocks import scores
from lodevec.operators.hnsw import HnswIndex, build
from lodevec.operators.hnsw import search as hnsw_search
from lodevec.operators.hnsw import update
from lodevec.operators.index import EmbeddingStore, SearchIndex
from lodevec.queries import QUERIES
from lodevec.runtime import materialise
from lodevec.sources.providers import HashProvider

KIND = "vec_id long, embedding array<float>, label string"


@pytest.fixture(scope="module")
def four(spark):
    return spark.createDataFrame([(0, [1.0, 0.0, 0.0], "a"), (1, [0.0, 1.0, 0.0], "b"), (2, [0.9, 0.1, 0.0], "c"), (3, [-1.0, 0.0, 0.0], "d")], KIND)


def random_table(spark, n, dim, seed=0):
    v = np.random.default_rng(seed).uniform(-1, 1, (n, dim)).astype(np.float32)
    return v, spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")


def test_top_k_and_filters(four):
    q = [1.0, 0.0, 0.0]
    assert [r.id for r in S.top_k(four, q, 2).collect()] == [0, 2]
    assert [r.id for r in S.top_k(four, q, 10, where="label <> 'a'").collect()] == [2, 1, 3]
    assert [r.id for r in S.above_threshold(four, q, 0.0).collect()] == [0, 2, 1]
    assert [r.id for r in S.rank_by_similarity(four, q).collect()] == [0, 2, 1, 3]
    for bad in (0, -1, 1.5, True):
        with pytest.raises(ValidationError):
            S.top_k(four, q, bad)
    with pytest.raises(ValidationError):
        S.above_threshold(four, q, float("nan"))


@pytest.mark.parametrize("metric", ["cosine", "dot", "euclidean", "manhattan"])
def test_blocks_agree_with_brute_force_and_expressions(spark, metric, monkeypatch):
    monkeypatch.setattr("lodevec.operators.blocks.BLOCK_ROWS", 16)
    v, df = random_table(spark, 60, 8)
    q = df.withColumnRenamed("vec_id", "query_id")
    s = scores(v.astype(float), v.astype(float), metric)
    want = np.lexsort((np.broadcast_to(np.arange(60), s.shape), -np.round(s, 9)), axis=1)[:, :7]
    for strategy in ("blocks", "expression"):
        got = S.top_k_multi(q, df, 7, metric, strategy=strategy).toPandas().sort_values(["query_id", "rank"])
        assert got["id"].to_numpy().reshape(60, 7).tolist() == want.tolist()


def test_ties_nulls_and_repeated_rows(spark):
    df = spark.createDataFrame([(3, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (None, [1.0, 0.0]), (4, None)], "vec_id long, embedding array<float>")
    got = S.top_k_multi(df.withColumnRenamed("vec_id", "query_id"), df, 3)
    assert {(r.query_id, r.rank, r.id) for r in got.collect()} == {(q, i + 1, i + 1) for q in (1, 2, 3) for i in range(3)}
    assert S.top_k_multi(df.withColumnRenamed("vec_id", "query_id").limit(0), df, 3).count() == 0


def greedy(v, t):
    kept = []
    for i in range(len(v)):
        if all(scores(v[i : i + 1], v[k : k + 1], "cosine")[0, 0] < t for k in kept):
            kept.append(i)
    return kept


@pytest.mark.parametrize("threshold", [-0.2, 0.3, 0.7])
def test_dedup_is_the_greedy_pass(spark, threshold):
    v, df = random_table(spark, 80, 4, 3)
    assert sorted(r.vec_id for r in S.deduplicate(df, threshold).collect()) == greedy(v.astype(float), threshold)
    assert S.deduplicate(df.limit(0), threshold).count() == 0


def test_matrix_and_pairs(four):
    m = {(r.i, r.j): r.score for r in S.similarity_matrix(four).collect()}
    assert len(m) == 16 and m[0, 0] == 1 and m[0, 3] == -1 and m[0, 2] == m[2, 0]
    assert {(r.a, r.b) for r in S.similar_pairs(four, 0.9).collect()} == {(0, 2)}
    with pytest.raises(ValidationError):
        S.pairwise_similarity(four, four.limit(2), "vec_id")


@pytest.mark.parametrize("lam", [0.0, 0.5, 1.0])
def test_mmr_follows_its_definition(spark, lam):
    v, df = random_table(spark, 30, 5, 1)
    q = spark.createDataFrame([(7, [1.0, 0.2, -0.3, 0.1, 0.5])], "query_id long, embedding array<float>")
    rel = scores(np.array([[1.0, 0.2, -0.3, 0.1, 0.5]], np.float32).astype(float), v.astype(float), "cosine")[0]
    pool = list(np.lexsort((np.arange(30), -np.round(rel, 9)))[:12])
    taken = []
    while len(taken) < 4:
        best = max(pool, key=lambda i: (round(lam * rel[i] - (1 - lam) * max([0, *(scores(v[i : i + 1].astype(float), v[j : j + 1].astype(float), "cosine")[0, 0] for j in taken)]), 12), -pool.index(i)))
        taken.append(int(best))
        pool.remove(best)
    got = S.mmr_search(q, df, 4, lam, 12).orderBy("rank").collect()
    assert [r.id for r in got] == taken and got[0].score == pytest.approx(rel[taken[0]])
    assert S.mmr_search(q, df, 0).count() == 0


def test_mmr_query_asks_every_hundredth_row(spark, tmp_path):
    v, _ = random_table(spark, 45, 6, 7)
    spark.createDataFrame([(i * 100, x.tolist(), i % 3) for i, x in enumerate(v)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {}
    for r in QUERIES["mmr_search"](spark, str(tmp_path)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id // 100, []).append(r.id // 100)
    s = scores(v.astype(float), v.astype(float), "cosine")
    assert len(got) == 45
    for q, ids in got.items():
        pool, taken = list(np.lexsort((np.arange(45), -np.round(s[q], 9)))[:40]), []
        while len(taken) < 10:
            best = max(pool, key=lambda i: (round(0.5 * s[q, i] - 0.5 * max([0, *s[i, taken]]), 12), -pool.index(i)))
            taken.append(int(best))
            pool.remove(best)
        assert ids == taken


def test_fusion_and_normalisation(spark):
    lists = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "c"), (2, 1, "b"), (2, 2, "c"), (2, 3, "d")], "list_id int, rank int, id string")
    got = S.fuse_ranked_lists(lists).orderBy("rank").collect()
    assert [r.id for r in got] == ["b", "c", "a", "d"] and got[0].score == pytest.approx(1 / 62 + 1 / 61)
    rows = spark.createDataFrame([(1, float(x)) for x in (10, 20, 30, 40, 50)] + [(2, 5.0), (2, 5.0)], "l int, score double")
    norm = lambda m: sorted((r.l, round(r.score, 6)) for r in S.normalize_scores(rows, m, ["l"]).collect())
    assert norm("min-max") == [(1, 0), (1, 0.25), (1, 0.5), (1, 0.75), (1, 1), (2, 1), (2, 1)]
    assert norm("z-score")[0] == (1, round(-20 / np.std([10, 20, 30, 40, 50]), 6)) and norm("z-score")[-1] == (2, 0)
    with pytest.raises(ValidationError):
        S.normalize_scores(rows, "rank", ["l"])


def test_index_replaces_and_removes(spark):
    index = SearchIndex(spark).add(spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, embedding array<float>"))
    index = index.add(spark.createDataFrame([(1, [0.0, 1.0])], "id long, embedding array<float>"))
    q = spark.createDataFrame([(0, [0.0, 1.0])], "query_id long, embedding array<float>")
    assert [r.id for r in index.search(q).orderBy("rank").collect()] == [1, 2] and index.size() == 2
    index = index.remove(spark.createDataFrame([(1,)], "id long"))
    assert [r.id for r in index.search(q, threshold=0.5).collect()] == [2]
    assert index.clear().size() == 0 and index.get(spark.createDataFrame([(2,)], "id long")).count() == 1
    assert [r.id for r in index.search(q, where="id > 2").collect()] == []


def test_results_hold_their_items(spark):
    """Vectors and metadata come with the results, filters see them, ids may be text, and long use keeps the plan short."""
    rows = spark.createDataFrame([("b", [1.0, 0.0], {"kind": "x"}), ("a", [1.0, 0.0], {"kind": "y"}), ("c", [0.0, 1.0], None)], "id string, embedding array<float>, metadata map<string,string>")
    index = SearchIndex(spark, id_type="string").add(rows)
    q = spark.createDataFrame([(0, [1.0, 0.1])], "query_id long, embedding array<float>")
    got = index.search(q, 2).orderBy("rank").collect()
    assert [(r.id, r.metadata, r.embedding) for r in got] == [("a", {"kind": "y"}, [1.0, 0.0]), ("b", {"kind": "x"}, [1.0, 0.0])]
    assert [r.id for r in index.search(q, 3, where="metadata['kind'] = 'x'").collect()] == ["b"]
    for i in range(20):
        index = index.add(spark.createDataFrame([(f"n{i}", [0.5, float(i)])], "id string, embedding array<float>"))
    assert index.size() == 23 and index.changes < 8 and index.items._jdf.queryExecution().logical().toString().count("Join") < 20


def test_store_finds_its_texts(spark):
    rows = spark.createDataFrame([(1, "cats purr softly", {"lang": "en"}), (2, "stock markets fell", {"lang": "en"}), (3, "bread needs yeast", {"lang": "fr"})], "id long, text string, metadata map<string,string>")

    class Counting(HashProvider):
        calls = 0

        def embed(self, texts, input_type=None):
            Counting.calls += 1
            return super().embed(texts, input_type)

    store = EmbeddingStore(spark, Counting(128), cache={"max_size": 10}).add_batch(rows)
    before = Counting.calls
    assert store.search("markets and stock", 1).first().id == 2 and store.search("markets and stock", 1).first().metadata == {"lang": "en"}
    assert Counting.calls == before + 1  # the second time the text is known
    assert [r.id for r in store.search("markets and stock", 3, where="metadata['lang'] = 'fr'").collect()] == [3]
    assert store.add(4, "dogs bark", {"lang": "en"}).search("dogs bark", 1).first().id == 4
    assert store.remove(spark.createDataFrame([(2,)], "id long")).size() == 2


def test_evaluation(spark):
    res = spark.createDataFrame([(1, i + 1, x) for i, x in enumerate("axcye")] + [(2, 1, "z")], "query_id int, rank int, id string")
    rel = spark.createDataFrame([(1, x, 1.0) for x in "ace"] + [(3, "q", 1.0)], "query_id int, id string, relevance double")
    got = {r.query_id: r for r in E.evaluate(res, rel, 3).collect()}
    assert got[1].recall == pytest.approx(2 / 3) and got[1].mrr == 1 and got[1].ap == pytest.approx((1 + 2 / 3 + 3 / 5) / 3)
    dcg = 1 + 1 / 2
    assert got[1].ndcg == pytest.approx(dcg / (1 + 1 / np.log2(3) + 1 / 2))
    assert tuple(got[2])[1:] == (0, 0, 0, 0) and tuple(got[3])[1:] == (0, 0, 0, 0)
    assert E.summary(E.evaluate(res, rel, 3)).first().queries == 3


@pytest.mark.parametrize("metric,least", [("cosine", 0.95), ("euclidean", 0.9), ("dot", 0.6), ("manhattan", 0.9)])
def test_graph_recall(metric, least):
    v = np.random.default_rng(5).uniform(-1, 1, (400, 24)).astype(np.float32)
    index = HnswIndex(metric, ef_construction=100)
    index.add_batch((str(i), x) for i, x in enumerate(v))
    s = scores(v[:40].astype(float), v.astype(float), metric)
    want = [set(map(str, np.argsort(-row)[:10])) for row in s]
    got = [{k for k, _ in index.search(x, 10, 100)} for x in v[:40]]
    assert np.mean([len(a & b) / 10 for a, b in zip(want, got)]) > least


def test_graph_changes_and_bytes():
    index = HnswIndex(m=4, ef_construction=20)
    v = np.random.default_rng(1).normal(size=(50, 6))
    index.add_batch((f"k{i}", x, {"even": i % 2 == 0}) for i, x in enumerate(v))
    assert index.search(v[7], 1)[0][0] == "k7" and all(int(k[1:]) % 2 == 0 for k, _ in index.search(v[7], 5, keep=lambda _, m: m["even"]))
    assert index.remove("k7") and not index.remove("k7") and index.search(v[7], 1)[0][0] != "k7" and len(index) == 49
    back = HnswIndex.from_bytes(index.to_bytes())
    assert len(back) == 49 and back.search(v[3], 1)[0][0] == "k3" and back.get("k2")[2] == {"even": True}
    for data in (b"", b"\x02", index.to_bytes()[:-3]):
        with pytest.raises(ValidationError):
            HnswIndex.from_bytes(data)
    for i in range(50):
        index.remove(f"k{i}")
    assert index.search(v[0]) == [] and len(index) == 0
    with pytest.raises(ValidationError):
        back.search([1.0])


def test_shards_together_find_the_neighbours(spark):
    v, df = random_table(spark, 300, 16, 2)
    got = hnsw_search(build(df, shard_rows=80), df.withColumnRenamed("vec_id", "query_id"), 5).groupBy("query_id").agg(F.collect_set("id").alias("ids")).collect()
    s = scores(v.astype(float), v.astype(float), "cosine")
    want = [set(np.argsort(-row)[:5].tolist()) for row in s]
    assert np.mean([len(want[r.query_id] & set(r.ids)) / 5 for r in got]) > 0.95


def recall(index, v, q, k, ef):
    want = np.argsort(-scores(q, v.astype(float), "cosine"), axis=1)[:, :k]
    got = index.search_batch(q, k, ef)[0]
    return np.mean([len(set(a) & set(b)) / k for a, b in zip(want.tolist(), got.tolist())])


def test_graph_recall_at_a_thousand_vectors():
    v = np.random.default_rng(0).uniform(-1, 1, (1000, 128)).astype(np.float32)
    index = HnswIndex("cosine", 16, 200)
    index.add_batch((str(i), x) for i, x in enumerate(v))
    assert recall(index, v, np.random.default_rng(1).uniform(-1, 1, (50, 128)), 10, 100) > 0.95


@pytest.mark.parametrize("seed", range(4))
def test_graph_recall_of_groups(seed):
    """Groups of near-equal vectors, whose nodes are linked to each other alone, at the query's own parameters."""
    r = np.random.default_rng(seed)
    v = (r.normal(size=(50, 32))[np.repeat(np.arange(50), 60)] + 0.05 * r.normal(size=(3000, 32))).astype(np.float32)
    index = HnswIndex()
    index.add_batch((str(i), x) for i, x in enumerate(v))
    assert recall(index, v, v[::30].astype(float), 10, 100) > 0.9


def test_bulk_and_single_adding_agree():
    """Links in bulk are those to the nearest earlier nodes, within their bounds, in both directions."""
    v = np.random.default_rng(2).normal(size=(200, 8)).astype(np.float32)
    index = HnswIndex("euclidean", 6, 300)
    index.add_batch((str(i), x) for i, x in enumerate(v[:100]))
    index.add_batch((str(i + 100), x, {"n": i}) for i, x in enumerate(v[100:]))
    slow = HnswIndex("euclidean", 6, 300)
    for i, x in enumerate(v):
        slow.add(str(i), x)
    assert [len(x) for x in index.links] == [len(x) for x in slow.links] and index.entry == slow.entry and index.get("150")[2] == {"n": 50}
    same = sum(a == b for x, y in zip(index.links, slow.links) for a, b in zip(x, y))
    assert same > 0.95 * sum(map(len, slow.links))
    for layer_of in index.links:
        assert all(len(near) <= (12 if layer == 0 else 6) for layer, near in enumerate(layer_of))
    assert all(n in index.links[x][layer] for n, layers in enumerate(index.links) for layer, near in enumerate(layers) for x in near)
    index.add_batch([("7", v[0])] * 70)
    assert len(index) == 200 and index.search(v[0], 2)[0][1] == pytest.approx(1)
    found, _ = index.search_batch(v[:5].astype(float), 3, keep=lambda key, meta: meta is not None)
    assert all(index.meta[n] is not None for n in found[found >= 0])


def test_saved_graph_changes(spark):
    v, df = random_table(spark, 120, 8, 5)
    df = df.withColumn("meta", F.create_map(F.lit("even"), (F.col("vec_id") % 2 == 0).cast("string")))
    index = materialise(build(df.where("vec_id < 100"), shard_rows=40, metadata="meta"), "graph")
    new = materialise(update(index, df.where("vec_id >= 100"), df.where("vec_id < 10"), metadata="meta"), "graph")
    q = df.select(F.col("vec_id").alias("query_id"), "embedding")
    first = {r.query_id: (r.id, r.metadata) for r in hnsw_search(new, q, 1, with_metadata=True).collect()}
    assert all(first[i] == (i, {"even": str(i % 2 == 0).lower()}) for i in range(10, 120)) and all(first[i][0] != i for i in range(10))
    kept = hnsw_search(new, q, 5, keep=lambda key, meta: meta["even"] == "true").collect()
    assert kept and all(r.id % 2 == 0 for r in kept)
    names = hnsw_search(build(df.withColumn("vec_id", F.concat(F.lit("k"), "vec_id"))), q, 1, id_type="string").collect()
    assert {(r.query_id, r.id) for r in names} == {(i, f"k{i}") for i in range(120)}


@pytest.mark.parametrize("metric", ["cosine", "dot", "euclidean", "manhattan"])
def test_verified_answers_are_the_nearest_however_poor_the_graph(spark, metric):
    """A thin graph and groups of copies, more than k in each: exact scores, and ties by number rather than by text."""
    r = np.random.default_rng(5)
    v = np.concatenate([np.repeat(r.normal(size=(15, 6)), 14, 0), r.normal(size=(190, 6))]).astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    q = df.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    got = hnsw_search(build(df, metric, m=2, ef_construction=2, shard_rows=150), q, 10, ef=10, exact=True)
    s = np.round(scores(v[::20].astype(float), v.astype(float), metric), 9)
    want = np.lexsort((np.broadcast_to(np.arange(len(v)), s.shape), -s), axis=1)[:, :10]
    rows = got.toPandas().sort_values(["query_id", "rank"])
    assert rows["id"].to_numpy().reshape(-1, 10).tolist() == want.tolist()
    few = hnsw_search(build(df.limit(4), metric), q, 10, exact=True, keep=lambda key, meta: key != "2")
    assert {(x.query_id, x.id) for x in few.collect()} == {(i, j) for i in range(0, 400, 20) for j in (0, 1, 3)}


def test_many_pairs_of_the_expression_go_by_tiles(spark, monkeypatch):
    v, df = random_table(spark, 120, 6, 9)
    q = df.where("vec_id % 10 = 0").withColumnRenamed("vec_id", "query_id")
    plan = lambda out: out._jdf.queryExecution().executedPlan().toString()
    rows = lambda out: [(r.query_id, r["rank"], r.id, round(r.score, 9)) for r in out.orderBy("query_id", "rank").collect()]
    few = S.top_k_multi(q, df, 7, strategy="expression")
    monkeypatch.setattr(S, "EXPRESSION_PAIRS", 12 * 120 - 1)
    many = S.top_k_multi(q, df, 7, strategy="expression")
    assert any(x in plan(few) for x in ("NestedLoop", "Cartesian")) and not any(x in plan(many) for x in ("NestedLoop", "Cartesian"))
    assert rows(few) == rows(many) and len(rows(many)) == 12 * 7


@pytest.mark.parametrize("k", [None, 2, 5])
def test_judgements_of_a_topic_count_for_each_of_its_queries(spark, k):
    """As if they were repeated for each query; also without a topic, without judgements, without results."""
    r = np.random.default_rng(7)
    topics = spark.createDataFrame([(q, ["a", "b", "c", None][q % 4]) for q in range(12)] + [(50, "a")], "query_id long, topic string")
    res = spark.createDataFrame([(q, i + 1, int(x)) for q in range(12) for i, x in enumerate(r.permutation(30)[: 1 + q % 7])], "query_id long, rank int, id long")
    rel = spark.createDataFrame([(t, int(x), float(r.integers(-1, 4))) for t in "ab" for x in r.integers(0, 30, 20)], "topic string, id long, relevance double")
    each = topics.join(rel, "topic").select("query_id", "id", "relevance")
    rows = lambda out: {x.query_id: pytest.approx(tuple(x)[1:]) for x in out.collect()}
    got, want = E.evaluate(res, rel, k, topics), E.evaluate(res, each, k)
    assert {x.query_id: tuple(x)[1:] for x in got.collect()} == rows(want) and got.count() == 13
