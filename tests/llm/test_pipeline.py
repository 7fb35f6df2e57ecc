import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

import corpus_pipeline
from lodevec.llm import langid, registry, simhash, toxicity
from lodevec.llm.pieces import MODEL

from .test_packing_tokens import naive_bfd


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    sf, base = "/root/testdata/sf0.01", tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], sf).write.parquet(f"{base}/{k}")
        out.append(spark.read.parquet(f"{base}/{k}"))
    return out


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language_id", "near_dedup", "best_fit_packing"]
    assert all(s.columns == stages[0].columns for s in stages[1:4])
    assert {f"op{n}" for n in range(1, 11)} <= {k.split("_")[0] for k in registry.queries()} and "pipeline" in registry.queries()


def test_filters_by_brute_force(spark, stages):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = [s.select("doc_id", "text").toPandas().sort_values("doc_id") for s in stages[:4]]
    model = toxicity.fit(stages[0], labels)
    p = model.probability(pa.array(rows[0]["text"]))
    assert rows[1]["doc_id"].tolist() == rows[0]["doc_id"][p < 0.5].tolist()
    lang = langid.fit(stages[1])
    best, posterior = lang.predict(pa.array(rows[1]["text"]))
    assert rows[2]["doc_id"].tolist() == rows[1]["doc_id"][(best >= 0) & (posterior >= 0.5)].tolist()
    fp, has = simhash.fingerprints_of(pa.array(rows[2]["text"]), simhash._signs())
    d = np.bitwise_count(fp[:, None] ^ fp[None]).sum(-1)
    close = (d <= simhash.RADIUS) & has[:, None] & has[None]
    label = np.arange(len(fp))
    while True:
        new = np.where(close, label[None], len(fp)).min(1)
        new = np.minimum(new, label)
        if (new == label).all():
            break
        label = new
    ids = rows[2]["doc_id"].to_numpy()
    want = set(ids[label == np.arange(len(fp))].tolist())
    got = set(rows[3]["doc_id"])
    assert want <= got and len(got - want) <= 0.1 * (len(ids) - len(want))


def test_packing_is_the_naive_one(stages):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    lengths = [len(x) for x in sp.encode([r.text or "" for r in stages[3].select("text").collect()])]
    pieces = [min(2048, n - s) for n in lengths for s in range(0, n, 2048)]
    fill = stages[4].groupBy("bin_id").sum("piece_len").collect()
    assert sorted(r[1] for r in fill) == naive_bfd(pieces, 2048)


def test_run_gives_the_last_stage(spark, stages):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.01")
    assert got.columns == stages[4].columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, stages[4].collect()))


def test_stages_on_odd_documents(spark, odd_docs):
    """Nulls, empty and very long texts, repeated rows and clashing names: each stage does what it says of them."""
    sf = "/root/testdata/sf0.01"
    clean, known, once, packed = (lambda docs, s=stage: s(spark, docs, sf) for _, stage in corpus_pipeline.STAGES)
    ids = lambda df: sorted(-1 if r.doc_id is None else r.doc_id for r in df.select("doc_id").collect())
    assert ids(clean(odd_docs)) == ids(odd_docs)
    spoken = set(ids(known(odd_docs)))
    assert spoken >= {1, 5, 6} and not {2, 3, 4, 8} & spoken
    assert ids(once(odd_docs)) == [-1, -1, 1, 2, 3, 4, 5, 6, 7, 8, 9]
    assert set(ids(packed(odd_docs))) == {-1, 1, 4, 5, 6, 7, 8, 9}
    for stage in (clean, known, once):
        assert stage(odd_docs).columns == odd_docs.columns and stage(odd_docs.limit(0)).count() == 0
    assert packed(odd_docs.limit(0)).count() == 0


def test_language_stage_rejects(spark, stages):
    """Texts in scripts that no document of a known language has, and without letters, go; the table's own stay."""
    docs = stages[1]
    odd = spark.createDataFrame([(10**9, "Жили были дед и баба, ели кашу с молоком. " * 4), (10**9 + 1, "12 34 -- !!"), (10**9 + 2, "これは日本語の文章です。" * 4)], "doc_id bigint, text string")
    both = docs.unionByName(odd, allowMissingColumns=True)
    kept = {r.doc_id for r in corpus_pipeline.language_stage(spark, both, "").select("doc_id").collect()}
    assert not kept & {10**9, 10**9 + 1, 10**9 + 2} and len(kept) >= 0.99 * docs.count()
