import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodevec.llm import langid, quality, toxicity
from lodevec.llm.textbytes import Hasher

from .conftest import prose


@pytest.fixture(scope="module")
def labelled(spark):
    """Documents and labels of the largest test table, with a held-out third that no fit sees."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    return docs, labels, held


# --- toxicity

def test_held_out_toxicity(labelled):
    docs, labels, held = labelled
    model = toxicity.fit(docs, labels.where(~held))
    truth = labels.where(held).select("doc_id", F.col("toxic").alias("truth"))
    got = toxicity.score(docs, model).join(truth, "doc_id").toPandas()
    hit, truth = got["toxic"].to_numpy(bool), got["truth"].to_numpy() == 1
    assert truth.sum() > 50 and (hit & truth).sum() / truth.sum() >= 0.85 and (hit & ~truth).sum() / (~truth).sum() <= 0.02


def dense_risk(w, x_p, x_u, prior):
    loss = lambda z: np.logaddexp(0, -z)
    z_p, z_u = x_p @ w[:-1] + w[-1], x_u @ w[:-1] + w[-1]
    return prior * loss(z_p).mean() + max(0.0, loss(-z_u).mean() - prior * loss(-z_p).mean())


def test_training_lowers_the_non_negative_risk():
    r = np.random.default_rng(0)
    kind = np.append(np.ones(60), (r.random(300) < 0.2).astype(float))
    x = (r.random((360, 30)) < np.where(kind[:, None] == 1, np.r_[np.full(5, 0.8), np.full(25, 0.3)], np.r_[np.full(5, 0.05), np.full(25, 0.3)])).astype(float)
    rows = [(np.flatnonzero(row).astype(np.int32), np.ones(int(row.sum()), np.float32)) for row in x]
    model = toxicity.nnpu(rows[:60], rows[60:], 0.2)
    w = np.append(model.weights[:30], model.bias)
    assert dense_risk(w, x[:60], x[60:], 0.2) < 0.6 * dense_risk(np.zeros(31), x[:60], x[60:], 0.2)
    right = ((x[60:] @ w[:-1] + w[-1] > 0) == (kind[60:] == 1)).mean()
    assert right >= 0.93


def brute_features(text):
    """How often each feature occurs, as (seed, bytes), and the number of words; without the operator's code."""
    words = re.findall(rb"[A-Za-z0-9\x80-\xff]+", text.lower().encode())
    grams = [(2, w[i : i + 5]) for w in words for i in range(len(w) - 4)]
    return Counter([(1, w) for w in words] + grams + [(3, w[:n]) for n in (6, 8) for w in words if len(w) > n]), len(words)


def bucket_of(seed, data):
    return int(Hasher(np.frombuffer(data, np.uint8))(np.array([0]), np.array([len(data)]), seed)[0] >> np.uint64(64 - toxicity.BUCKET_BITS))


def test_scores_by_brute_force(spark):
    """p_toxic of whole documents from their features, counted one by one."""
    texts = [prose(i, 30 + i) + " Übergrößenträger größtmögliches " * (i % 3) for i in range(20)] + ["", None, "--", "a"]
    r = np.random.default_rng(3)
    model = toxicity.ToxicModel(np.where(r.random(toxicity.BUCKETS) < 0.5, 0.0, r.normal(size=toxicity.BUCKETS)), -0.3, 0.1)
    got = toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), model).collect()
    for row, text in zip(sorted(got), texts):
        counts, words = brute_features(text or "")
        by_bucket = Counter()
        for f, n in counts.items():
            by_bucket[bucket_of(*f)] += n
        z = model.bias + sum(model.weights[b] * np.sqrt(n) for b, n in by_bucket.items()) / np.sqrt(max(words, 1))
        assert row.p_toxic == pytest.approx(1 / (1 + np.exp(-z)) if words else 0.0, abs=1e-4) and row.toxic == (row.p_toxic >= 0.5)


def slow_nnpu(x_p, x_u, prior, epochs, batches=4, rate=0.05, decay=1e-4):
    """The same estimator on dense rows: features chosen and scaled, then steps of Adam on the risk, row by row."""
    rng = np.random.default_rng(toxicity.SEED)
    in_p, in_u, n_p, n_u = (x_p > 0).sum(0), (x_u > 0).sum(0), len(x_p), len(x_u)
    share = (in_p + in_u) / (n_p + n_u)
    error = np.sqrt(np.maximum(share * (1 - share), 1 / (n_p + n_u) ** 2) * (1 / n_p + 1 / n_u))
    scale = np.where(np.abs(in_p / n_p - in_u / n_u) < toxicity.SIGNIFICANT * error, 0, np.log((in_p + 1) / (n_p + 1)) - np.log((in_u + 1) / (n_u + 1)))
    x = np.hstack([np.vstack([x_p, x_u]) * scale, np.ones((n_p + n_u, 1))])
    w, m, v, mean, kept, step = *np.zeros((4, x.shape[1])), 0, 0
    for epoch in range(epochs):
        parts = list(zip(np.array_split(rng.permutation(n_p), batches), np.array_split(n_p + rng.permutation(n_u), batches)))
        for p, u in parts:
            toxic = lambda i: 1 / (1 + np.exp(-x[i] @ w))
            loss_clean = lambda rows: sum(np.log1p(np.exp(x[i] @ w)) for i in rows) / len(rows)
            negative = loss_clean(u) - prior * loss_clean(p)
            g_u, g_p = sum(toxic(i) * x[i] for i in u) / len(u), sum(toxic(i) * x[i] for i in p) / len(p)
            plus = sum((toxic(i) - 1) * x[i] for i in p) / len(p)
            g = prior * plus + g_u - prior * g_p if negative >= 0 else prior * g_p - g_u
            g = g + decay * np.append(w[:-1], 0) / (len(p) + len(u))
            step += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            if epoch >= epochs // 2:
                mean, kept = mean + w, kept + 1
    w = mean / kept
    out = w[:-1] * scale
    return np.where(np.abs(out) < toxicity.PRUNE * np.abs(out).max(), 0, out), w[-1]


def test_fit_by_brute_force():
    r = np.random.default_rng(1)
    toxic = r.random(80) < 0.25
    draw = lambda kind: (r.random((len(kind), 12)) < np.where(kind[:, None], [0.9, 0.7, 0.6, *[0.3] * 9], [0.05, 0.1, 0.3, *[0.3] * 9])) * r.integers(1, 4, (len(kind), 12)).astype(float)
    x_p, x_u = draw(np.ones(40, bool)), draw(toxic)
    sparse = lambda x: [(np.flatnonzero(row).astype(np.int32), row[row > 0].astype(np.float32)) for row in x]
    model = toxicity.nnpu(sparse(x_p), sparse(x_u), 0.25, epochs=12)
    weights, bias = slow_nnpu(x_p, x_u, 0.25, 12)
    assert model.weights[:12] == pytest.approx(weights, abs=1e-6) and model.bias == pytest.approx(bias, abs=1e-6) and not model.weights[12:].any() and weights.any()


def test_features_are_words_and_grams_of_the_whole_text():
    text = "abcdef " * 20_000 + "zebra"
    data = np.frombuffer(text.encode(), np.uint8)
    bucket, owner, words = toxicity.features(data, np.array([0, len(data)]))
    alone, _, _ = toxicity.features(np.frombuffer(b"zebra", np.uint8), np.array([0, 5]))
    assert words.tolist() == [20_001] and set(alone.tolist()) <= set(bucket.tolist()) and len(bucket) == 20_000 * 3 + 2


def test_toxicity_of_odd_documents(spark, odd_docs):
    labels = spark.createDataFrame([(1, 0, 1), (5, 1, 0), (None, 1, 1), (6, 1, None)], "doc_id bigint, quality int, toxic int")
    model = toxicity.fit(odd_docs, labels)
    got = toxicity.score(odd_docs, model).collect()
    assert len(got) == odd_docs.count() and all(r.p_toxic == 0 for r in got if r.doc_id in (2, 3, 4))
    kept = toxicity.drop_toxic(odd_docs, model)
    assert kept.columns == odd_docs.columns and {2, 3, 4} <= {r.doc_id for r in kept.collect()}
    named = odd_docs.withColumnsRenamed({"doc_id": "k", "text": "body"})
    other = labels.unionByName(labels).withColumnsRenamed({"doc_id": "k", "toxic": "bad"})
    assert (toxicity.fit(named, other, text="body", key="k", toxic="bad").weights == model.weights).all()
    for none in (toxicity.fit(odd_docs, labels.limit(0)), toxicity.fit(odd_docs.limit(0), labels)):
        assert toxicity.drop_toxic(odd_docs, none).count() == odd_docs.count()
    assert toxicity.score(odd_docs.limit(0), model).count() == 0


# --- languages

def test_held_out_languages(labelled):
    docs, _, held = labelled
    model = langid.fit(docs.where(~held))
    got = langid.identify(docs.where(held), model).join(docs.select("doc_id", "lang"), "doc_id")
    right, kept, n = got.agg(F.avg((F.col("predicted_lang") == F.col("lang")).cast("int")), F.avg(F.col("keep").cast("int")), F.count("*")).first()
    assert n > 2000 and right >= 0.97 and kept >= 0.97


def brute_grams(text):
    """The n-grams of a text's characters as strings, without the operator's code."""
    t = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in text.lower())
    return [(n, g) for n in (2, 3, 4) for i in range(len(t) - n + 1) if " " not in (g := t[i : i + n])[1:-1] and g.strip()]


def brute_bayes(examples, text, smoothing=0.1):
    """Log-likelihoods, gram by gram."""
    out = {}
    for name in {x for x, _ in examples}:
        counts = Counter(g for x, t in examples if x == name for g in brute_grams(t))
        total = sum(counts.values()) + smoothing * langid.BUCKETS
        out[name] = np.log(sum(x == name for x, _ in examples) / len(examples)) + sum(np.log((counts[g] + smoothing) / total) for g in brute_grams(text))
    return out


def test_model_is_naive_bayes(spark):
    examples = [("en", "the house and the river"), ("en", "a stone bridge"), ("de", "das haus und der fluss"), ("fr", "la maison et la rivière"), ("ru", "дом и река, мост 12"), ("ja", "日本語の 本"), ("hi", "नदी का पुल")]
    model = langid.fit(spark.createDataFrame(examples, "lang string, text string"))
    texts = ["the bridge", "das Haus", "rivière la", "zq", "Река и МОСТ", "日本", "पुल 😀 का"]
    scores, _ = model.scores(pa.array(texts))
    for t, row in zip(texts, scores):
        want = brute_bayes(examples, t)
        assert row == pytest.approx([want[x] for x in model.languages], abs=1e-3)


def test_grams_stay_within_words_and_texts():
    points = lambda *t: langid.code_points(np.frombuffer("".join(t).encode(), np.uint8), np.cumsum([0, *(len(x.encode()) for x in t)]))
    alone = [langid.ngrams(*points(t)) for t in ("дом", "ab")]
    both = langid.ngrams(*points("дом", "ab"))
    assert all((np.concatenate([x, y]) == z).all() for x, y, z in zip(*alone, both))
    found, at = langid.code_points(np.frombuffer(b"a\xffb" + "é".encode(), np.uint8), np.array([0, 3, 5]))
    assert "".join(map(chr, found)) == "a\ufffdbé" and at.tolist() == [0, 3, 4]


def test_languages_of_odd_documents(spark, odd_docs):
    model = langid.fit(odd_docs)
    assert model.languages == ["en", "fr"]
    got = {(r.doc_id, r.predicted_lang, r.keep) for r in langid.identify(odd_docs, model).collect()}
    assert {(2, "und", False), (3, "und", False), (4, "und", False), (8, "und", False), (1, "en", True), (6, "en", True)} <= got
    kept = langid.keep_known(odd_docs, model)
    assert kept.columns == odd_docs.columns and {r.doc_id for r in kept.collect()} >= {1, 5, 6}
    foreign = spark.createDataFrame([(1, "Жили были дед и баба ели кашу с молоком " * 5), (2, prose(9, 40))], "doc_id bigint, text string")
    assert {r.doc_id: r.keep for r in langid.identify(foreign, model).collect()} == {1: False, 2: True}
    assert {r.doc_id: r.keep for r in langid.identify(foreign, model, accept=("fr",)).collect()} == {1: False, 2: False}
    none = langid.fit(odd_docs.limit(0))
    assert none.languages == [] and langid.identify(odd_docs, none).where("keep").count() == 0 and langid.identify(odd_docs.limit(0), model).count() == 0


# --- quality

def test_quality_agrees_with_labels_that_it_never_saw(labelled):
    docs, labels, _ = labelled
    got = quality.assess(docs).join(labels, "doc_id").where("toxic = 0")
    row = got.groupBy("quality").agg(F.avg(F.col("keep").cast("int")).alias("kept")).toPandas().set_index("quality")["kept"]
    assert row[1] >= 0.98 and row[0] <= 0.35


def slow_em(votes, rules, rounds):
    """The same fit, one document at a time."""
    prior, good_right, bad_right = 0.9, [0.99] * rules, [0.3] * rules
    for _ in range(rounds):
        post = []
        for v in votes:
            g, b = prior, 1 - prior
            for k, x in enumerate(v):
                if x:
                    g *= good_right[k] if x == 2 else 1 - good_right[k]
                    b *= bad_right[k] if x == 1 else 1 - bad_right[k]
            post.append(g / (g + b))
        n = len(votes)
        prior = (sum(post) + 9) / (n + 10)
        for k in range(rules):
            good_right[k] = (sum(p for p, v in zip(post, votes) if v[k] == 2) + 99) / (sum(p for p, v in zip(post, votes) if v[k]) + 100)
            bad_right[k] = (sum(1 - p for p, v in zip(post, votes) if v[k] == 1) + 3) / (sum(1 - p for p, v in zip(post, votes) if v[k]) + 10)
    return prior, good_right, bad_right


def test_fit_is_expectation_maximisation_over_documents():
    r = np.random.default_rng(0)
    good = r.random(300) < 0.8
    votes = np.where(r.random((300, 4)) < 0.2, 0, np.where(r.random((300, 4)) < np.where(good[:, None], 0.95, 0.3), 2, 1))
    codes = votes @ 3 ** np.arange(4)
    patterns, counts = np.unique(codes, return_counts=True)
    model = quality.fit_votes(patterns, counts.astype(float), 4, rounds=15)
    prior, good_right, bad_right = slow_em(votes.tolist(), 4, 15)
    assert model.prior == pytest.approx(prior) and model.right_good == pytest.approx(good_right) and model.right_bad == pytest.approx(bad_right)
    assert ((quality.fit_votes(patterns, counts.astype(float), 4).posterior(codes) >= 0.5) == good).mean() > 0.9


def test_features_by_plain_counting():
    text = "The cat | the CAT! cat cat #1 größer\n"
    got = {k: float(v[0]) for k, v in quality.features(pa.array([text])).items()}
    assert got["words"] == 8 and got["bars_a_word"] == 1 / 8 and got["shouts_a_word"] == 1 / 8 and got["symbols_a_word"] == 2 / 8
    assert got["top_word_share"] == 4 / 8 and got["repeat_share"] == 2 / 8 and got["word_bytes"] == pytest.approx((3 * 6 + 1 + 8) / 8)


def brute_votes(text):
    """The ten votes of a text, rule by rule, by plain counting over its bytes; without the operator's code."""
    raw, small = (text or "").encode(), (text or "").lower().encode()
    find = lambda data: re.findall(rb"[A-Za-z0-9\x80-\xff]+", data)
    words = find(raw)
    if not words:
        return [0] * 9 + [1]
    n, lows = len(words), find(small)
    letter = lambda c: 65 <= c <= 90 or 97 <= c <= 122 or c >= 128
    large = [c for c in (text or "") if "A" <= c <= "Z" or "À" <= c <= "Þ"]
    latin = [c for c in raw if letter(c) and c < 128] + [c for a, c in zip(raw, raw[1:]) if a == 0xC3 and c >= 128]
    pairs = list(zip(lows, lows[1:]))
    grade = lambda x, good, bad: 2 if good[0] <= x <= good[1] else 1 if bad[0] <= x <= bad[1] else 0
    inf, few = float("inf"), n < 20
    visible = [c for c in raw if c not in b"\t\n\x0b\x0c\r "]
    return [
        grade(sum(map(len, words)) / n, (2.5, 12), (20, inf)),
        grade(sum(c in b"#$%&*<>=@[]^_`{}~\\/+|" for c in raw) / n, (0, 0.05), (0.25, inf)),
        grade(len(large) / max(1, len(latin)), (0, 0.25), (0.5, inf)),
        0 if few else grade(max(Counter(lows).values()) / n, (0, 0.15), (0.3, inf)),
        0 if few else grade(sum(a == b for a, b in pairs) / n, (0, 0.05), (0.2, inf)),
        grade(raw.count(b"|") / n, (0, 0.02), (0.2, inf)),
        grade(raw.count(b"!") / n, (0, 0.05), (0.3, inf)),
        grade(sum(map(letter, raw)) / len(visible), (0.85, 1), (0, 0.8)),
        0 if few else grade(1 - len(set(pairs)) / len(pairs), (0, 0.2), (0.4, 1)),
        grade(n, (20, inf), (0, 0)),
    ]


def test_votes_by_brute_force(spark):
    """The votes of every document of a test table and of odd ones."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    odd = ["", " \n", "ÄÖÜ SHOUT!!! NOW!!! " * 9, "a | b | c | d " * 8, "buy now " * 40, "x" * 500, "1 2 3 4 # $ % ^ & *", "ÀÉ ß ÿ Ø ×"]
    docs = docs.unionByName(spark.createDataFrame([(10**9 + i, t) for i, t in enumerate([*odd, None])], "doc_id bigint, text string"))
    got = {r.doc_id: r.votes for r in quality.vote_patterns(docs).collect()}
    for r in docs.collect():
        assert [got[r.doc_id] // 3**k % 3 for k in range(10)] == brute_votes(r.text), r.text[:80]
    assert len(set(got.values())) > 10


def test_quality_of_odd_documents(spark, odd_docs):
    got = quality.assess(odd_docs).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.p_quality <= 1 for r in got)
    empty = {r.votes for r in got if r.doc_id in (2, 3, 4)}
    assert empty == {3 ** (len(quality.RULES) - 1)}  # only the rule on the number of words, against them
    assert quality.assess(odd_docs.limit(0)).count() == 0
