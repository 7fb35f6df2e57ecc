import gzip
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodevec.llm import urlfilter, warc

RECORD = "record_id bigint, kind string, url string, captured timestamp, status int, profile string, headers map<string,string>, body string"


@pytest.mark.parametrize("listed,rest", [(0, 100), (100, 0), (1, 5000), (3000, 3000), (2000, 10)])
def test_cascade_is_exact_over_its_universe(listed, rest):
    r = np.random.default_rng(listed + rest)
    h = r.integers(0, 2**64, (2, listed + rest), dtype=np.uint64)
    levels = urlfilter.build((h[0, :listed], h[1, :listed]), (h[0, listed:], h[1, listed:]))
    answer = urlfilter.ask(levels, h[0], h[1])
    assert answer[:listed].all() and not answer[listed:].any()
    if listed == 1:
        assert sum(len(x.bits) for x in levels) < 100


URLS = ["http://a.example/x", "HTTPS://A.example/x/", "http://b.example/y#frag", "http://b.example/z", "ftp://c.example", "", None, "http://d.example/" + "p" * 5000, "no scheme/path", "http://a.example:80/x?q=1"]


@pytest.mark.parametrize("limit", [64 << 20, 0])  # cascades that travel, and those met by segment
def test_filter_marks_exactly_the_listed(spark, monkeypatch, limit):
    monkeypatch.setattr(urlfilter, "BROADCAST_BYTES", limit)
    monkeypatch.setattr(urlfilter, "SEGMENT_KEYS", 3)
    rows = [(i, u) for i, u in enumerate(URLS)] + [(0, URLS[0]), (None, URLS[2])]
    pages = spark.createDataFrame([(*r, "x", 1, True) for r in rows], "page_id bigint, url string, key string, h1 bigint, url_listed boolean")
    hosts = spark.createDataFrame([("b.example",), (None,), ("elsewhere",), ("b.example",)], "key string")
    urls = spark.createDataFrame([("a.example/x",), ("no scheme/path",)], "key string")
    got = urlfilter.filter_pages(pages, hosts, urls).collect()
    want = sorted((i if i is not None else -1, u or "", "b.example/" in (u or ""), u in ("http://a.example/x", "HTTPS://A.example/x/", "no scheme/path")) for i, u in rows)
    assert sorted((r.page_id if r.page_id is not None else -1, r.url or "", r.host_listed, r.url_listed) for r in got) == want
    assert all(r.blocked == (r.host_listed or r.url_listed) for r in got)
    assert urlfilter.filter_pages(pages.limit(0), hosts, urls).count() == 0
    assert urlfilter.filter_pages(pages, hosts.limit(0), urls.limit(0)).where("blocked").count() == 0


def test_canonical_urls(spark):
    pairs = {
        "HTTP://WWW.Example.com:80/A/b/#x": "example.com/A/b", "https://example.com/?b=2&utm_source=q&a=1": "example.com?a=1&b=2", "example.com": "example.com",
        "http://example.com:8080/": "example.com:8080", "https://example.com/p?ref=x": "example.com/p", "http://e.com?x=1": "e.com?x=1", "": "", "http://e.com/p?&&": "e.com/p", "http://e.com/a?u=http://x.y/?z#f": "e.com/a?u=http://x.y/?z",
    }
    df = spark.createDataFrame([(u,) for u in pairs] + [(None,)], "url string")
    got = {r.url: r.c for r in df.select("url", warc.canonical_url(F.col("url")).alias("c")).collect()}
    assert got == {**pairs, None: None}


def brute(records):
    """Resolution record by record: (outcome, source id, headers)."""
    out = []
    for r in records:
        headers = {}
        for k, v in (r["headers"] or {}).items():
            headers[k.lower()] = v
        canonical = None if r["url"] is None else r["url"].removeprefix("http://")
        full = r["kind"] == "response" and r["status"] == 200 and canonical is not None and r["captured"] is not None and r["record_id"] is not None
        out.append({**r, "canonical": canonical, "headers": headers, "full": full})
    answer = []
    for r in out:
        if r["full"]:
            answer.append(("full", r["record_id"], r["headers"]))
            continue
        if not (r["kind"] == "revisit" and warc.PROFILE in (r["profile"] or "")):
            answer.append(("other", None, r["headers"]))
            continue
        earlier = [s for s in out if s["full"] and r["canonical"] is not None and s["canonical"] == r["canonical"] and r["captured"] is not None and s["captured"] < r["captured"]]
        if not earlier:
            answer.append(("missing", None, r["headers"]))
            continue
        s = max(earlier, key=lambda s: (s["captured"], s["record_id"]))
        tag = lambda h: (h.get("etag") or "").removeprefix("W/") or None
        same = tag(r["headers"]) == tag(s["headers"]) if tag(r["headers"]) else r["headers"].get("last-modified") is not None and r["headers"].get("last-modified") == s["headers"].get("last-modified")
        merged = {**s["headers"], **{k: v for k, v in r["headers"].items() if k not in warc.KEPT}}
        answer.append(("resolved", s["record_id"], merged) if same else ("mismatch", None, r["headers"]))
    return answer


def test_revisits_by_brute_force(spark):
    r = random.Random(0)
    start = datetime(2024, 1, 1)
    rows = []
    for i in range(400):
        kind = r.choice(["response", "response", "revisit", "revisit", "revisit", "request", None])
        headers = {k: v for k, v in (("ETag", r.choice(['"1"', 'W/"1"', '"2"', ""])), ("Last-Modified", r.choice(["a", "b"])), ("Content-Length", str(i)), ("X-N", str(i))) if r.random() < 0.6}
        rows.append({
            "record_id": r.choice([i, i, i, i, None]), "kind": kind, "url": r.choice([f"http://e.com/{k}" for k in range(6)] + [None]), "captured": None if r.random() < 0.05 else start + timedelta(minutes=r.randint(0, 40)),
            "status": r.choice([200, 200, 200, 404, None]), "profile": r.choice([warc.PROFILE, "http://x/revisit/server-not-modified", "identical-payload-digest", None]) if kind == "revisit" else None, "headers": headers or None, "body": f"body {i}",
        })
    df = spark.createDataFrame([tuple(x.values()) for x in rows], RECORD)
    clash = df.withColumn("canonical", F.lit("x")).withColumn("source", F.lit(1)).withColumn("outcome", F.lit("y"))
    got = warc.resolve_revisits(clash).collect()
    key = lambda o, s, h, i: (o, -1 if s is None else s, tuple(sorted(h.items())), -1 if i is None else i)
    want = sorted(key(*a, x["record_id"]) for a, x in zip(brute(rows), rows))
    assert sorted(key(g.outcome, g.source_id, g.headers, g.record_id) for g in got) == want
    assert {w[0] for w in want} == {"full", "resolved", "mismatch", "missing", "other"}
    assert all(g.body == f"body {g.source_id}" for g in got if g.source_id is not None) and all(g.body is None for g in got if g.source_id is None)
    assert warc.resolve_revisits(df.limit(0)).count() == 0


def test_same_time_and_repeated_header_names(spark):
    t = datetime(2024, 1, 1)
    rows = [(1, "response", "http://e.com/", t, 200, None, {"ETag": '"1"', "etag": '"2"'}, "one"), (2, "revisit", "http://e.com", t, 304, warc.PROFILE, {"etag": '"2"'}, None), (3, "revisit", "http://e.com", t + timedelta(seconds=1), 304, warc.PROFILE, {"Etag": 'W/"2"'}, None)]
    got = {r.record_id: (r.outcome, r.body) for r in warc.resolve_revisits(spark.createDataFrame(rows, RECORD)).collect()}
    assert got == {1: ("full", "one"), 2: ("missing", None), 3: ("resolved", "one")}


def record(kind, uri, date, block, more=""):
    return f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:{kind}:{date}>\r\nWARC-Target-URI: {uri}\r\nWARC-Date: {date}\r\n{more}Content-Type: application/http\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def test_files_are_read(spark, tmp_path):
    full = b'HTTP/1.1 200 OK\r\nETag: "x"\r\nContent-Type: text/html\r\n\r\n<p>WARC/1.1 inside</p>'
    old = b'HTTP/1.1 304 Not Modified\r\nETag: W/"x"\r\nDate: today\r\n\r\n'
    data = record("response", "http://e.com/", "2024-01-01T00:00:00Z", full) + record("revisit", "https://www.e.com", "2024-01-02T00:00:00Z", old, f"WARC-Profile: http://p/{warc.PROFILE}\r\n")
    (tmp_path / "a.warc").write_bytes(data)
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(x) for x in (data[: data.index(b"WARC/1.1\r\nWARC-Type: revisit")], data[data.index(b"WARC/1.1\r\nWARC-Type: revisit") :])))
    for name in ("a.warc", "b.warc.gz"):
        got = {r.kind: r for r in warc.resolve_revisits(warc.read_warc(spark, str(tmp_path / name))).collect()}
        assert got["revisit"].outcome == "resolved" and got["revisit"].body == b"<p>WARC/1.1 inside</p>" and got["revisit"].headers == {"etag": '"x"', "content-type": "text/html", "date": "today"}
        assert got["response"].captured == datetime(2024, 1, 1)
    (tmp_path / "c.warc").write_bytes(b"")
    assert warc.read_warc(spark, str(tmp_path / "c.warc")).count() == 0


def test_damaged_files_give_their_whole_records(tmp_path, spark):
    page = b"HTTP/1.1 200 OK\r\n\r\n\xff\xd8 not text"
    one, two = (record("response", f"http://e.com/{i}", f"2024-01-0{i}T00:00:00Z", page) for i in (1, 2))
    bad = one.replace(f"Content-Length: {len(page)}".encode(), b"Content-Length: many")
    assert bad != one
    bodies = lambda data: [(r["url"], r["body"]) for r in warc.parse_records(data)]
    first, second = ("http://e.com/1", b"\xff\xd8 not text"), ("http://e.com/2", b"\xff\xd8 not text")
    assert bodies(one + two) == [first, second] and bodies(bad + two) == [second] and bodies(one + two[:-30]) == [first]
    assert bodies(b"noise\n" + one + b"more noise\r\n" + two) == [first, second] and bodies(b"") == []
    packed = gzip.compress(one) + gzip.compress(two)
    assert bodies(packed) == [first, second] and bodies(packed[:-20]) == [first] and bodies(gzip.compress(one + two)) == [first, second]
    assert bodies(gzip.compress(one) + b"\x00" * 7 + gzip.compress(two)) == [first, second] and bodies(gzip.compress(one) + b"junk" * 9) == [first]
    (tmp_path / "x.warc.gz").write_bytes(packed[:-20])
    (tmp_path / "y.warc").write_bytes(two)
    assert sorted(bytes(r.body) for r in warc.read_warc(spark, str(tmp_path)).collect()) == [b"\xff\xd8 not text"] * 2


def test_hot_segments_have_several_copies(spark, monkeypatch):
    """One host with most of the rows, by segments: every row has the answer that the small way gives."""
    rows = [(i, f"http://{'hot' if i % 3 else f'h{i}'}.example/{i}") for i in range(300)] + [(1, "http://hot.example/1")] * 3
    pages = spark.createDataFrame(rows, "page_id bigint, url string")
    hosts = spark.createDataFrame([("hot.example",), ("h3.example",)], "key string")
    urls = spark.createDataFrame([("hot.example/7",)], "key string")
    small = sorted(map(tuple, urlfilter.filter_pages(pages, hosts, urls).collect()))
    for name, value in (("BROADCAST_BYTES", 0), ("SEGMENT_KEYS", 20), ("SEGMENT_ROWS", 10)):
        monkeypatch.setattr(urlfilter, name, value)
    plan = urlfilter.filter_pages(pages, hosts, urls)
    assert sorted(map(tuple, plan.collect())) == small and "Join" not in plan._jdf.queryExecution().executedPlan().toString()
