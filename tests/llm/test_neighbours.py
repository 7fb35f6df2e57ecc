import random

import numpy as np
import pyarrow as pa
import pytest

from lodevec.llm import ann, simhash

from .conftest import WORDS, prose


def changed(text, seed, share):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) if r.random() < share else w for w in text.split())


def fps(texts):
    return simhash.fingerprints_of(pa.array(texts), simhash._signs())[0]


def distances(fp):
    return np.bitwise_count(fp[:, None] ^ fp[None]).sum(-1)


def test_fingerprints_tell_copies_from_others():
    base = [prose(i, 200) for i in range(40)]
    near = [changed(t, i, 0.05) for i, t in enumerate(base)]
    d = distances(fps(base + near))
    own = d[np.arange(40), np.arange(40) + 40]
    assert (own <= simhash.RADIUS).mean() >= 0.9
    d[np.arange(40), np.arange(40) + 40] = d[np.arange(40) + 40, np.arange(40)] = 256
    np.fill_diagonal(d, 256)
    assert d.min() > simhash.RADIUS
    same = fps(["Hello, big WORLD of words", "hello big world of words!", None, "", " -- "])
    assert (same[0] == same[1]).all() and not same[2:].any()


@pytest.mark.parametrize("n", [10, 50_000, 2_000_000, 10**9])
def test_plan_reaches_its_recall(n):
    rec = simhash.plan(n)
    assert rec.recall >= simhash.TARGET_RECALL and rec.repeats >= 1


def test_recursion_finds_pairs_at_the_radius():
    r = np.random.default_rng(0)
    rec = simhash.plan(2_000_000)
    assert rec.levels
    a = r.integers(0, 2**63, (300, simhash.WORDS), dtype=np.uint64)
    flips = np.zeros((300, simhash.BITS), np.uint8)
    for row in flips:
        row[r.permutation(simhash.BITS)[: simhash.RADIUS]] = 1
    b = a ^ np.packbits(flips, axis=1, bitorder="little").view(np.uint64)
    met = np.zeros(300, bool)
    for repeat in range(rec.repeats):
        rows, lists = simhash.lists_of(np.concatenate([a, b]), rec, repeat)
        left = {(i, x) for i, x in zip(rows, lists) if i < 300}
        for i, x in zip(rows, lists):
            if i >= 300 and (i - 300, x) in left:
                met[i - 300] = True
    assert met.mean() >= 0.87  # 0.92 in expectation


def brute_groups(ids, texts):
    keep = [i for i, t in enumerate(texts) if simhash.fingerprints_of(pa.array([t]), simhash._signs())[1][0]]
    d = distances(fps([texts[i] for i in keep]))
    label = {ids[i]: ids[i] for i in keep}
    again = True
    while again:
        again = False
        for x, y in zip(*np.nonzero(d <= simhash.RADIUS)):
            a, b = ids[keep[x]], ids[keep[y]]
            if label[a] < label[b]:
                label[b] = label[a]
                again = True
    return {k: v for k, v in label.items() if k != v}


def test_duplicates_are_those_of_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LIST_SIZE", 20)  # so that the recursion is in use
    texts = [prose(i, 120) for i in range(60)]
    texts += [changed(texts[i], 100 + i, 0.04) for i in range(0, 30)] + [texts[5]] * 3 + [texts[7].upper()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.duplicate_of for r in simhash.duplicates(docs).collect()}
    want = brute_groups(list(range(len(texts))), texts)
    assert len(want) > 25 and len(set(got) & set(want)) >= 0.9 * len(want) and set(got) <= set(want)
    assert {k: got[k] for k in (90, 91, 92, 93)} == {90: 5, 91: 5, 92: 5, 93: 7}
    kept = {r.doc_id for r in simhash.drop_duplicates(docs).collect()}
    assert kept == set(range(len(texts))) - set(got)


def test_duplicates_of_odd_documents(spark, odd_docs):
    kept = simhash.drop_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, -1, 1, 2, 3, 4, 5, 6, 7, 8, 9]  # the repeated row goes
    assert [tuple(r) for r in simhash.duplicates(odd_docs).collect()] == [(1, 1)]
    assert simhash.duplicates(odd_docs.limit(0)).count() == 0 and simhash.drop_duplicates(odd_docs.limit(0)).count() == 0


def test_rows_go_by_themselves(spark):
    """Rows of one key with different texts are judged apart; null and text keys work."""
    a, b = prose(1, 80), prose(2, 80)
    docs = spark.createDataFrame([("k", a), ("k", b), ("m", a), (None, b), (None, a), ("z", prose(3, 80))], "doc_id string, text string")
    assert sorted((str(r.doc_id), r.duplicate_of) for r in simhash.duplicates(docs).collect()) == [("None", "k"), ("None", "k"), ("m", "k")]
    assert sorted((r.doc_id, r.text) for r in simhash.drop_duplicates(docs).collect()) == sorted([("k", a), ("k", b), ("z", prose(3, 80))])


def test_long_lists_are_compared_by_chunks(spark, monkeypatch):
    """Chunks give the groups that a list in one piece gives."""
    base = prose(0, 150)
    texts = [changed(base, i, 0.05) for i in range(60)] + [prose(i, 150) for i in range(100, 130)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    whole = {tuple(r) for r in simhash.duplicates(docs).collect()}
    monkeypatch.setattr(simhash.near_edges, "__defaults__", (simhash.RADIUS, simhash.TARGET_RECALL, 8))
    assert {tuple(r) for r in simhash.duplicates(docs).collect()} == whole and len(whole) > 40
    fp = np.random.default_rng(1).integers(0, 4, (70, simhash.WORDS), dtype=np.uint64)
    first = np.random.default_rng(2).random(70) < 0.5
    x, y = simhash.close_across(fp, first, 2, block=7)
    d = distances(fp)
    assert set(zip(x.tolist(), y.tolist())) == {(i, j) for i in range(70) for j in range(70) if first[i] and not first[j] and d[i, j] <= 2}


def test_texts_without_spaces_have_words():
    r = random.Random(1)
    signs = [chr(0x4E00 + r.randrange(3000)) for _ in range(300)]
    near = [*signs[:100], "新", *signs[101:]]
    data = "".join(signs).encode() + b" word"
    start, end, _ = simhash._words(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    assert [data[a:b].decode() for a, b in zip(start, end)] == [*signs, "word"]
    d = distances(fps(["".join(signs), "".join(near), "".join(chr(0x4E00 + r.randrange(3000)) for _ in range(300))]))
    assert d[0, 1] <= simhash.RADIUS < d[0, 2]


def test_close_pairs_are_exhaustive():
    fp = np.random.default_rng(1).integers(0, 4, (90, simhash.WORDS), dtype=np.uint64)
    x, y = simhash.close_pairs(fp, 2, block=7)
    d = distances(fp)
    assert set(zip(x.tolist(), y.tolist())) == {(i, j) for i in range(90) for j in range(i + 1, 90) if d[i, j] <= 2}


def brute_knn(v, k):
    d = ((v[:, None] - v[None]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    return np.argsort(d, axis=1, kind="stable")[:, :k], np.sqrt(np.sort(d, axis=1)[:, :k])


@pytest.mark.parametrize("clustered", [False, True])
def test_neighbours_have_the_recall(spark, monkeypatch, clustered):
    monkeypatch.setattr(ann, "CELL_ROWS", 150)
    monkeypatch.setattr(ann, "LEAF_ROWS", 16)
    r = np.random.default_rng(0)
    v = r.normal(size=(600, 32)) * 0.3 + (r.normal(size=(12, 32))[r.integers(0, 12, 600)] * 3 if clustered else 0)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id bigint, embedding array<double>")
    got = ann.knn(df, 10).toPandas()
    want, _ = brute_knn(v, 10)
    own = got.groupby("query_id")["neighbour_id"].apply(set)
    assert len(got) == 6000 and np.mean([len(own[i] & set(want[i].tolist())) / 10 for i in range(600)]) >= 0.9
    i, j = got["query_id"].to_numpy(), got["neighbour_id"].to_numpy()
    assert np.allclose(np.linalg.norm(v[i] - v[j], axis=1), got["distance"]) and (i != j).all()
    assert all(g["distance"].is_monotonic_increasing for _, g in got.sort_values("rank").groupby("query_id"))


def test_pieces_and_strips_lose_no_neighbour(spark, monkeypatch):
    """Equal vectors, which no cut can part, and queries of several strips: every list is full and exact."""
    monkeypatch.setattr(ann, "CELL_ROWS", 40)
    monkeypatch.setattr(ann, "LEAF_ROWS", 16)
    monkeypatch.setattr(ann, "STRIP_QUERIES", 25)
    r = np.random.default_rng(4)
    v = np.concatenate([np.ones((200, 8)), r.normal(size=(300, 8)) * 5])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id bigint, embedding array<float>")
    got = ann.knn(df, 5, confidence=0.999, where="vec_id % 3 = 0").toPandas()
    _, want = brute_knn(v.astype(np.float32).astype(float), 5)
    assert len(got) == 5 * 167 and not got.duplicated(["query_id", "neighbour_id"]).any()
    for q, g in got.sort_values(["query_id", "rank"]).groupby("query_id"):
        assert np.allclose(g["distance"], want[q], rtol=0.02, atol=1e-6)


def test_stopping_rule():
    for k, p in ((4, 0.5), (16, 0.95), (16, 0.05)):
        draws = np.random.default_rng(k).chisquare(k, 200_000)
        q = ann.chi2_quantile(p, k)
        assert (draws < q).mean() == pytest.approx(p, abs=0.01) and ann.chi2_cdf(q, k) == pytest.approx(p, abs=1e-6)


def test_neighbours_of_odd_vectors(spark):
    rows = [(1, [0.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None), (None, [1.0, 1.0]), (5, [float("nan"), 0.0]), (6, [1.0]), (7, [None, 1.0]), (8, [float("inf"), 1.0]), (9, [])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id bigint, embedding array<float>, cell int, home string")
    got = {(r.query_id, r.rank): r.neighbour_id for r in ann.knn(df, 5).collect()}
    assert got == {(1, 1): 2, (1, 2): 3, (2, 1): 1, (2, 2): 3, (3, 1): 1, (3, 2): 2}
    assert ann.knn(df.limit(0)).count() == 0
    named = spark.createDataFrame([("a", [0.0]), ("b", [1.0]), ("c", [3.0])], "vec_id string, embedding array<double>")
    assert {(r.query_id, r.rank, r.neighbour_id) for r in ann.knn(named, 1, where="vec_id <> 'b'").collect()} == {("a", 1, "b"), ("c", 1, "b")}
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], "vec_id bigint, embedding array<float>")
    assert {(r.query_id, r.rank): r.neighbour_id for r in ann.knn(same, 2).collect()}[(4, 1)] in range(4)
    with pytest.raises(ValueError):
        ann.knn(df, 0)
