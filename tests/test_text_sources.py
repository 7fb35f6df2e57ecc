import functools
import json
import os
import struct
from datetime import datetime

import numpy as np
import pytest

from lodevec.errors import DimensionMismatchError, ModelNotFoundError, ProviderError, ValidationError
from lodevec.functions import text as T
from lodevec.operators.clustering import GreedyConfig, IncrementalClusterer
from lodevec.sources import cache, codec, models
from lodevec.sources import providers as P
from lodevec.streaming import online
from lodevec.streaming.pipeline import EmbeddingPipeline, FileCheckpoint, RateLimiter, batches


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_word_chunks(spark):
    words = " ".join(f"w{i}" for i in range(30))
    df = docs(spark, words, None, "", " \n\t ", "one")
    got = T.chunk_by_tokens(df, 13, 5).orderBy("doc_id", "chunk_no").collect()
    own = [r.chunk.split() for r in got if r.doc_id == 0]
    assert own[0] == [f"w{i}" for i in range(10)] and own[1][:3] == ["w7", "w8", "w9"] and own[-1][-1] == "w29"
    assert [len(c) for c in own] == [10, 10, 10, 9, 2] and {r.doc_id for r in got} == {0, 4}
    assert T.chunk_by_tokens(df.limit(1), 1).count() == 30
    with pytest.raises(ValidationError):
        T.chunk_by_tokens(df, 0)


def test_sentences(spark):
    text = 'First one. Second "quoted one." Third? Yes! No full stop'
    assert [s.strip() for s in T.sentences(text)] == ["First one.", 'Second "quoted one."', "Third?", "Yes!", "No full stop"]
    assert "".join(T.sentences(text)) == text and T.sentences("Version 1.5 is e.g. fine.") == ["Version 1.5 is e.g. fine."]
    assert T.pack_sentences("A b. C d. E f.", 6) == ["A b. C d. ", "E f."]
    assert T.pack_sentences("A b. C d. E f.", 6, 3) == ["A b. C d. ", "C d. E f."]
    assert T.pack_sentences("A long one here indeed. B.", 2) == ["A long one here indeed. ", "B."] and T.pack_sentences(None) == []
    assert T.chunk_by_sentence(docs(spark, "A. B.", None, "  "), None).count() == 2


MARKDOWN = """# Top

Intro text. More of it.

## Code
```python
x = 1

# not a heading
```
- one

- two
  more

| a | b |
|---|---|

### Deep
~~~~
```
~~~
open"""


def test_markdown_structure(spark):
    got = T.structure_chunks(MARKDOWN)
    assert [(c["type"], c["headings"]) for c in got] == [("heading", ["Top"]), ("paragraph", ["Top"]), ("heading", ["Top", "Code"]), ("code", ["Top", "Code"]), ("list", ["Top", "Code"]), ("paragraph", ["Top", "Code"]), ("table", ["Top", "Code"]), ("heading", ["Top", "Code", "Deep"]), ("code", ["Top", "Code", "Deep"])]
    assert got[4]["text"] == "- one\n\n- two" and got[3]["text"].endswith("```") and got[8]["text"].endswith("open")
    assert all(MARKDOWN[c["offset"] :].startswith(c["text"]) for c in got)
    again = T.structure_chunks("## A\n### B\n# C\ntext")
    assert again[-1]["headings"] == ["C"]
    long = "One is here. Two is here. Three is here. Four is here."
    parts = T.structure_chunks(long, 7)
    assert [p["text"] for p in parts] == ["One is here. Two is here.", "Three is here. Four is here."] and [long[p["offset"] :].startswith(p["text"]) for p in parts] == [True] * 2
    assert T.structure_chunks(long, 8, 4)[1]["text"].startswith("Two is here.")
    assert T.structure_chunks("  ") == [] and T.structure_chunks(None) == []
    assert T.chunk_by_structure(docs(spark, MARKDOWN, None, "")).count() == 9


def test_codecs(spark):
    v = [[1.0, 2.5], [-3.0, 0.0]]
    for how in codec.FORMATS:
        back, meta = codec.deserialize(codec.serialize(v, how, {"model": "m"}), how)
        assert np.array_equal(back, v) and meta == (None if how == "json" else {"model": "m"})
    old = struct.pack("<I", 1) + struct.pack("<I2f", 2, 1.5, 2.5)
    assert codec.deserialize(old)[0][0].tolist() == [1.5, 2.5]
    assert codec.serialize([])[0] == 2 and codec.deserialize(codec.serialize([]))[0] == []
    with pytest.raises(DimensionMismatchError):
        codec.serialize([[1.0], [1.0, 2.0]])
    for bad in (b"\x02\x00", b""):
        with pytest.raises(ValidationError):
            codec.deserialize(bad)
    with pytest.raises(ValidationError):
        codec.serialize(v, "xml")
    df = spark.createDataFrame([(v,), (None,), ([],)], "v array<array<float>>").select(codec.serialize_column("v").alias("b"))
    assert [r.x for r in df.select(codec.deserialize_column("b").alias("x")).collect()] == [v, None, []]


def test_lru_cache():
    now = [0.0]
    c = cache.LruCache(2, 10, lambda: now[0])
    cache.warm(c, [("a", [1]), ("b", [2])])
    assert c.get("a") == [1]
    c.set("c", [3])
    assert not c.has("b") and c.has("a") and c.stats().evictions == 1
    value = c.get("a")
    value.append(9)
    assert c.get("a") == [1]
    now[0] = 11
    assert c.get("a") is None and c.stats().misses == 1 and c.stats().hit_rate == pytest.approx(0.75)
    assert c.delete("c") and not c.delete("c")
    c.clear()
    assert c.stats().size == 0
    with pytest.raises(ValidationError):
        cache.LruCache(0)


def test_models(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(models, "REGISTRY", dict(models.REGISTRY))
    with pytest.raises(ModelNotFoundError):
        models.model_info("x")
    models.register_model(models.ModelInfo("own/model", 512, 1024))
    for bad in (models.ModelInfo("own/model", 3, 3), models.ModelInfo(" ", 3, 3), models.ModelInfo("y", 0, 3)):
        with pytest.raises(ValidationError):
            models.register_model(bad)
    models.register_model(models.ModelInfo("own/model", 256, 1024), overwrite=True)
    assert models.model_info("own/model").dimensions == 256 and models.registry_frame(spark).count() == 9
    assert models.tokenizer_info("own/model")["max_tokens"] == 1024 and models.tokenizer_info("x") is None
    assert models.recommended_model("multilingual").dimensions == 384
    models.set_model_path(tmp_path)
    assert models.list_models() == []
    models.download_model("own/model", lambda m, folder: (folder / "x").write_text(m))
    models.download_model("other/thing", lambda m, folder: None)
    assert {(m.id, m.dimensions) for m in models.list_models()} == {("own/model", 256), ("other/thing", 0)}
    assert models.delete_model("own/model") and not models.delete_model("own/model")


def test_offline_provider(spark):
    p = P.HashProvider(32)
    a, b = p.embed(["hello world", "hello world"]).embeddings
    assert a == b and np.linalg.norm(a) == pytest.approx(1)
    assert P.HashProvider(32, query_prefix="q: ").embed(["x y"], "query").embeddings != p.embed(["x y"], "query").embeddings
    with pytest.raises(ValidationError):
        p.embed([])
    got = {r.doc_id: r.embedding for r in P.embed(docs(spark, "a", None, ""), p).collect()}
    assert got[1] is None and len(got[0]) == 32 and got[2] == [0.0] * 32
    local = P.LocalProvider(lambda m: lambda texts: [np.array([[1.0, 0.0, 2.0], [1.0, 2.0, 0.0]]) for _ in texts], "own", 2)
    assert local.embed(["x"]).embeddings[0] == pytest.approx([2**-0.5, 2**-0.5])


def test_http_providers_batch_retry_and_fail():
    calls = []

    def post(url, headers, body, timeout):
        calls.append((url, headers, body))
        if len(calls) == 1:
            return 503, {"error": "busy"}
        return 200, {"data": [{"index": i, "embedding": [float(len(t))]} for i, t in reversed(list(enumerate(body["input"])))], "usage": {"total_tokens": 3}}

    p = P.openai_compatible("key", "m", "http://x/v1/", max_batch=2, post=post)
    p.retries = 1
    out = P.retry_with_backoff(lambda: p.embed(["a", "bb", "ccc"]), sleep=lambda s: None)
    assert out.embeddings == [[1.0], [2.0], [3.0]] and out.tokens == 6 and calls[0][0] == "http://x/v1/embeddings" and calls[0][1]["Authorization"] == "Bearer key"
    bad = P.create_provider("mistral", api_key="k", model="m", post=lambda *a: (401, {"error": "no"}))
    with pytest.raises(ProviderError) as e:
        bad.embed(["a"])
    assert e.value.status_code == 401 and not P.retryable(e.value)
    with pytest.raises(ProviderError):
        P.openai_compatible("k", "m", post=lambda *a: (200, {})).embed(["a"])
    seen = []
    co = P.cohere("k", post=lambda u, h, b, t: (seen.append(b), (200, {"embeddings": [[1.0]] * len(b["texts"])}))[1])
    co.embed(["q"], "query")
    assert seen[0]["input_type"] == "search_query"
    vertex = P.google_vertex("p", lambda: "token", post=lambda u, h, b, t: (200, {"predictions": [{"embeddings": {"values": [1.0], "statistics": {"token_count": 2}}}] * len(b["instances"])}))
    assert vertex.embed(["a"] * 7).tokens == 14
    with pytest.raises(ValidationError):
        P.create_provider("x")


def test_retries_and_batches():
    waits, n = [], [0]

    def call():
        n[0] += 1
        raise ProviderError("x", "p", 429)

    with pytest.raises(ProviderError):
        P.retry_with_backoff(call, 3, 1.0, 3.0, sleep=waits.append)
    assert n[0] == 4 and len(waits) == 3 and 1 <= waits[0] <= 1.3 and waits[2] == 3
    seen = []
    for workers in (1, 3):
        assert P.auto_batch(list(range(7)), 3, lambda p: [x * 2 for x in p], workers, on_progress=lambda a, b: seen.append((a, b))) == [x * 2 for x in range(7)]
    assert seen == [(1, 3), (2, 3), (3, 3)] * 2
    assert list(batches(range(5), 2)) == [[0, 1], [2, 3], [4]]


def test_cached_provider_asks_only_for_what_is_missing():
    class Counting(P.HashProvider):
        asked: list = []

        def embed(self, texts, input_type=None):
            self.asked.append(list(texts))
            return super().embed(texts, input_type)

    p = P.with_cache(Counting(8))
    p.embed(["a", "b"])
    out = p.embed(["b", "c", "a"])
    assert p.inner.asked == [["a", "b"], ["c"]] and out.embeddings == P.HashProvider(8).embed(["b", "c", "a"]).embeddings
    p.embed(["a"], "query")
    assert p.inner.asked[-1] == ["a"]


def test_rate_limiter():
    now = [0.0]
    limit = RateLimiter(60, 600, lambda: now[0], lambda s: now.__setitem__(0, now[0] + s))
    for _ in range(60):
        limit.wait(10)
    assert now[0] == pytest.approx(0)
    limit.wait(10)
    assert now[0] == pytest.approx(1, abs=0.05)
    with pytest.raises(ValidationError):
        limit.wait(601)
    with pytest.raises(ValidationError):
        RateLimiter(0)


def test_local_pipeline_resumes(tmp_path):
    class Failing(P.HashProvider):
        def embed(self, texts, input_type=None):
            if "bad" in texts:
                raise ProviderError("x", "p", 400)
            return super().embed(texts, input_type)

    check = FileCheckpoint(str(tmp_path / "state.json"))
    own = EmbeddingPipeline(Failing(4), batch_size=2, checkpoint=check, checkpoint_interval=1)
    with pytest.raises(ProviderError):
        own.run_local(["a", "b", "bad"], ["1", "2", "3"])
    assert json.loads((tmp_path / "state.json").read_text())["completed_ids"] == ["1", "2"]
    out = EmbeddingPipeline(P.HashProvider(4), batch_size=2, checkpoint=check).run_local(["a", "b", "bad"], ["1", "2", "3"])
    assert out[:2] == [None, None] and out[2] is not None
    for ids in (["1"], ["1", "1", "2"]):
        with pytest.raises(ValidationError):
            own.run_local(["a", "b", "c"], ids)


def test_table_pipeline_resumes(spark, tmp_path):
    rows = docs(spark, "a", "b", "c", None).withColumnRenamed("doc_id", "id")
    own, path = EmbeddingPipeline(P.HashProvider(4), requests_per_minute=6000), str(tmp_path / "out")
    assert own.run_into(rows.where("id < 2"), path) == 2 and own.run_into(rows, path) == 4 and own.run_into(rows, path) == 4
    assert spark.read.parquet(path).where("embedding is null").count() == 1


def test_streams(spark, tmp_path):
    src = str(tmp_path / "src")
    for i in range(3):
        spark.createDataFrame([(10 * i + k, f"text {k}", [float(k), 1.0]) for k in range(4)], "id long, text string, embedding array<float>").coalesce(1).write.mode("append").parquet(src)
    schema = spark.read.parquet(src).schema
    stream = online.file_stream(spark, src, schema, 1)
    EmbeddingPipeline(P.HashProvider(4)).run_stream(stream.select("id", "text"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 12
    clusterer = IncrementalClusterer(GreedyConfig(0.99))
    online.cluster_stream(online.file_stream(spark, src, schema, 1), clusterer, str(tmp_path / "c"), str(tmp_path / "cc"), "id").awaitTermination()
    assert clusterer.size == 12 and spark.read.parquet(str(tmp_path / "c")).count() == 12
    mean = online.averages(spark, src, schema, []).first()
    assert mean.embedding == [1.5, 1.0] and mean["count"] == 12


def test_pool_stops_at_the_first_failure():
    begun = []

    def task(i):
        begun.append(i)
        if i == 3:
            raise ProviderError("no", "p", 400)
        return i * 2

    assert P.in_pool([functools.partial(task, i) for i in (0, 1, 2)], 2) == [0, 2, 4]
    begun.clear()
    with pytest.raises(ProviderError):
        P.in_pool([functools.partial(task, i) for i in range(100)], 1)
    assert begun == [0, 1, 2, 3]
    with pytest.raises(ProviderError):
        P.auto_batch(list(range(100)), 1, lambda part: [task(part[0])], concurrency=2)
    assert len(begun) < 50 and P.in_pool([], 3) == []


def test_pipeline_calls_at_a_time(tmp_path):
    import threading
    import time

    class Slow(P.HashProvider):
        now, most, lock = 0, 0, threading.Lock()

        def embed(self, texts, input_type=None):
            with Slow.lock:
                Slow.now += 1
                Slow.most = max(Slow.most, Slow.now)
            time.sleep(0.05)
            with Slow.lock:
                Slow.now -= 1
            return super().embed(texts, input_type)

    texts, seen = [f"text {i}" for i in range(20)], []
    run = EmbeddingPipeline(Slow(8), batch_size=2, concurrency=3, checkpoint=FileCheckpoint(str(tmp_path / "c")), on_progress=seen.append)
    assert run.run_local(texts) == P.HashProvider(8).embed(texts).embeddings and 2 <= Slow.most <= 3
    assert [p.done_batches for p in seen] == list(range(1, 11)) and run.run_local(texts) == [None] * 20


@pytest.mark.parametrize("how", codec.FORMATS)
def test_codec_columns(spark, how):
    rows = [(0, [[1.0, 2.0], [3.0, 4.5]]), (1, None), (2, []), (3, [[0.25]])]
    df = spark.createDataFrame(rows, "id int, v array<array<float>>")
    packed = df.select("id", codec.serialize_column("v", how).alias("b"))
    for r in packed.collect():
        assert r.b is None if rows[r.id][1] is None else (bytes(r.b) if how == "binary" else r.b) == codec.serialize(rows[r.id][1], how)
    assert {r.id: r.v for r in packed.select("id", codec.deserialize_column("b", how).alias("v")).collect()} == dict(rows)


def test_windows_over_several_batches(spark, tmp_path):
    """Windows that later batches change have their last value; events behind the watermark are left out."""
    kind = "ts timestamp, event_type string, value double"
    at = lambda h, m=0: datetime(2024, 1, 1, h, m)
    for i, rows in enumerate(([(at(1), "a", 1.0), (at(1, 30), "a", 2.0)], [(at(1, 45), "a", 4.0), (at(9), "b", 1.0)], [(at(9, 10), "b", 2.0)], [(at(1, 50), "a", 64.0), (at(9, 30), "b", 1.0)])):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
        os.utime(next(p for p in sorted((tmp_path / "events").glob("*.parquet"), key=os.path.getmtime, reverse=True)), (i * 100 + 1e9, i * 100 + 1e9))
    got = online.event_windows(spark, str(tmp_path / "events"), spark.createDataFrame([], kind).schema, files_a_batch=1).collect()
    assert sorted((r.event_type, r.window_start.hour, r.n, r.total) for r in got) == [("a", 1, 3, 7.0), ("b", 9, 3, 4.0)]


def test_stream_of_batches_is_one_online_clustering(spark, tmp_path):
    v = np.random.default_rng(0).normal(size=(60, 3)).astype(np.float32)
    for i in range(3):
        spark.createDataFrame([(k, v[k].tolist()) for k in range(i * 20, i * 20 + 20)], "vec_id long, embedding array<float>").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        os.utime(next(p for p in sorted((tmp_path / "in").glob("*.parquet"), key=os.path.getmtime, reverse=True)), (i * 100 + 1e9, i * 100 + 1e9))
    whole = spark.read.parquet(str(tmp_path / "in"))
    own = IncrementalClusterer(GreedyConfig(0.8))
    online.cluster_stream(online.file_stream(spark, str(tmp_path / "in"), whole.schema, 1), own, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    want = {r.vec_id: r.cluster_id for r in online.cluster_batches(whole, GreedyConfig(0.8)).collect()}
    assert {r.vec_id: r.cluster_id for r in spark.read.parquet(str(tmp_path / "out")).collect()} == want and own.size == 60 and len(own.clusters()) == max(want.values()) + 1


def test_hashed_sums_are_those_of_single_tokens(monkeypatch):
    """Words and trigrams one by one, over pieces, slots that are shared and a table of words that is full."""
    import hashlib

    texts = ["", "a", "ab", "A b\tc", "ab " * 40, "İstanbul ÄÖ 漢字漢字 \U0001f600\U0001f601 z", "x" * 300, "the cat sat on the mat " * 9, "\ud800ab"]
    want = np.zeros((len(texts), 16))
    for row, t in zip(want, map(str.lower, texts)):
        for token in [*t.split(), *(t[i : i + 3] for i in range(len(t) - 2))]:
            h = int.from_bytes(hashlib.blake2b(token.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
            row[h % 16] += 1.0 if h >> 63 else -1.0
    for name, value in (("PIECE", 50), ("MOST_WORDS", 3), ("TRIGRAM_SLOTS", 4), ("_known", []), ("_words", {})):
        monkeypatch.setattr(P, name, value)
    assert (P._token_sums(texts, 16) == want).all() and (P._token_sums(texts, 16) == want).all()


def test_equal_tokens_are_hashed_once(monkeypatch):
    asked = []
    real = P._token_hash
    monkeypatch.setattr(P, "_known", [])
    monkeypatch.setattr(P, "_words", {})
    monkeypatch.setattr(P, "_token_hash", lambda token: asked.append(token) or real(token))
    P.HashProvider(8).embed(["one two two"] * 50)
    P.HashProvider(16).embed(["one two two"] * 50)
    assert len(asked) == len(set(asked)) + sum(x in ("one", "two") for x in set(asked))  # as a word and as a trigram


def test_equal_tokens_are_looked_up_once(monkeypatch):
    """The tables are asked for each different word and trigram, not for each of their occurrences."""
    words, trigrams = [], []

    class Noted(dict):
        def get(self, word, default=None):
            words.append(word)
            return super().get(word, default)

    real = P._trigram_hashes
    monkeypatch.setattr(P, "_words", Noted())
    monkeypatch.setattr(P, "_trigram_hashes", lambda codes: trigrams.append(len(codes)) or real(codes))
    P.HashProvider(8).embed(["one two two"] * 50)
    assert sorted(words) == ["one", "two"] and trigrams == [len({"one two two"[i : i + 3] for i in range(9)})]


@pytest.mark.parametrize("letters", [0, 6, 128])
def test_hashed_sums_of_numbered_trigrams_and_runs_of_words(monkeypatch, letters):
    """With few letters and with many, over runs of words and both generations of known ones, texts shorter than a trigram between others."""
    import hashlib

    texts = ["", "a", "ab", "abc", "", "b", "the cat the dog the cat", "cab " * 9, "漢字漢字 é \U0001f600 \ud800", "x" * 40, "ab", "z", ""]
    want = np.zeros((len(texts), 5))
    for row, t in zip(want, texts):
        for token in [*t.split(), *(t[i : i + 3] for i in range(len(t) - 2))]:
            h = int.from_bytes(hashlib.blake2b(token.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
            row[h % 5] += 1.0 if h >> 63 else -1.0
    for name, value in (("LETTERS", letters), ("RUN", 4), ("MOST_WORDS", 2), ("_known", []), ("_words", {}), ("_older", {})):
        monkeypatch.setattr(P, name, value)
    assert (P._token_sums(texts, 5) == want).all() and (P._token_sums(texts[::-1], 5) == want[::-1]).all()
    assert all((P._token_sums([t], 5) == row).all() for t, row in zip(texts, want)) and len(P._words) <= 2 and len(P._older) <= 2


def test_known_short_words_are_found_by_their_bytes(monkeypatch):
    """Words of up to 15 bytes that are known aren't made strings and looked up by name again."""
    asked, real = [], P._word_hashes
    monkeypatch.setattr(P, "_known", [])
    monkeypatch.setattr(P, "_words", {})
    monkeypatch.setattr(P, "_word_hashes", lambda words: asked.extend(words) or real(words))
    texts = ["One two two", "fifteen-letters sixteen--letters", "élan\u2003two", "", "one"] * 20
    first = P.HashProvider(8).embed(texts).embeddings
    assert {"one", "two", "fifteen-letters", "sixteen--letters", "élan"} == set(asked)
    asked.clear()
    assert P.HashProvider(8).embed(texts).embeddings == first and asked == ["sixteen--letters"] * 20


@pytest.mark.parametrize("piece, slots", [(1 << 18, 1 << 20), (7, 1 << 20), (40, 2)])
def test_words_are_those_of_split(monkeypatch, piece, slots):
    """Every kind of space, zero bytes, words of any number of bytes that begin alike, slots that are shared and long texts."""
    for name, value in (("PIECE", piece), ("WORD_SLOTS", slots), ("RUN", 4), ("_known", []), ("_words", {}), ("_older", {})):
        monkeypatch.setattr(P, name, value)
    spaces = [chr(i) for i in range(0x110000) if chr(i).isspace()]
    alike = [c * n for c in ("a", "é", "漢", "a\0") for n in range(1, 20)] + ["a\0", "a", "\0", "\0\0", "x" * 300, "\ud800\udc00", "’tis", "\u180eb"]
    texts = ["", " ", " ".join(alike), *(s.join(["a", "bc", "", "d"]) for s in spaces), "".join(s + w for s, w in zip(spaces * 9, alike)), "\u3000a\u3000", "b" * 90]
    for _ in range(2):
        counts, hashes = P._words_of(texts)
        assert counts.tolist() == [len(t.split()) for t in texts] and hashes.tolist() == [P._token_hash(w) for t in texts for w in t.split()]
        assert [w for t in texts for part in P._parted(t) for w in part.split()] == [w for t in texts for w in t.split()] and all("".join(P._parted(t)) == t for t in texts)
    assert max(len(part) for part in P._parted("ab " * 90)) <= piece + 3


def test_store_embeds_a_text_once(spark, tmp_path):
    from lodevec.operators.index import EmbeddingStore

    class Noted(P.HashProvider):
        def embed(self, texts, input_type=None):
            for t in texts:
                with open(self.path, "a") as f:
                    f.write(f"{t}\n")
            return super().embed(texts, input_type)

    provider = Noted(8)
    provider.path = str(tmp_path / "asked")
    docs = spark.createDataFrame([(i, f"text number{i}") for i in range(6)], "id long, text string")
    asked = spark.createDataFrame([(1, "what text")], "query_id long, text string")
    assert EmbeddingStore(spark, provider).add_batch(docs).search_texts(asked, 3).count() == 3
    lines = open(provider.path).read().split("\n")[:-1]
    assert sorted(lines) == sorted([f"text number{i}" for i in range(6)] + ["what text"])


def test_structure_is_chunked_a_few_texts_at_a_time(spark, monkeypatch):
    """Batches are handed on slice by slice; the rows are those of whole batches, keys of any type."""
    monkeypatch.setattr(T, "SLICE_ROWS", 3)
    monkeypatch.setattr(T, "SLICE_CHARS", 60)
    texts = ["# a\n\nOne. Two. Three.", None, "", "plain " * 30, "- x\n- y", "# b\n\n```\ncode\n```", "é" * 70, "last"]
    df = spark.createDataFrame([(f"k{i}", t) for i, t in enumerate(texts)], "doc_id string, text string").coalesce(1)
    want = [(f"k{i}", n, c["text"], c["headings"], c["offset"], c["type"]) for i, t in enumerate(texts) for n, c in enumerate(T.structure_chunks(t, 3, 1))]
    out = T.chunk_by_structure(df, 3, 1)
    assert sorted(tuple(r) for r in out.collect()) == sorted(want) and out.columns == ["doc_id", "chunk_no", "chunk", "headings", "offset", "type"]
    assert "MapInArrow" in out._jdf.queryExecution().executedPlan().toString()
