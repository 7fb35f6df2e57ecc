import random

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from lodevec.llm import lattice, packing, tokenbin, wordcache
from lodevec.llm.pieces import MODEL

from .conftest import prose

SP = sentencepiece.SentencePieceProcessor(model_file=MODEL)


def naive_bfd(lengths, capacity):
    """The fill of every bin by plain best fit decreasing; bins of equal room are interchangeable."""
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [(r, i) for i, r in enumerate(room) if r >= n]
        if fits:
            _, i = min(fits)
            room[i] -= n
        else:
            room.append(capacity - n)
    return sorted(capacity - r for r in room)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60), st.integers(20, 45))
def test_plan_is_best_fit_decreasing(lengths, capacity):
    histogram = {n: lengths.count(n) for n in set(lengths)}
    runs, bins = packing.plan_bins(histogram, capacity)
    content, filled = {}, {}
    for n, count in histogram.items():
        for rank in range(count):
            own = runs[runs[:, 0] == n]
            _, first, bin_, each, offset = own[np.searchsorted(own[:, 1], rank, side="right") - 1]
            b = bin_ + (rank - first) // each
            content.setdefault(b, []).append(n)
            filled.setdefault(b, []).append((offset + (rank - first) % each * n, n))
    assert sorted(map(sum, content.values())) == naive_bfd(lengths, capacity) and bins == len(content)
    for parts in filled.values():  # no overlap and no hole
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n


def test_tree_finds_the_tightest():
    r = random.Random(0)
    tree, there = packing.CapacityTree(50), {}
    for i in range(300):
        c = r.randint(1, 50)
        tree.push(c, i, 1)
        there[c] = there.get(c, 0) + 1
        need = r.randint(1, 50)
        want = min((k for k, n in there.items() if n and k >= need), default=None)
        assert tree.tightest(need) == want
        if want is not None and r.random() < 0.7:
            tree.pop(want)
            there[want] -= 1


def test_placement_is_the_same_at_every_size(spark, monkeypatch):
    """However many parts the ranks of a length are cut into, each piece goes where it went."""
    lengths = spark.createDataFrame([(i, 5 + i % 3) for i in range(200)], "doc_id bigint, n_tokens bigint")
    want = None
    for rows in (10**6, 50, 7, 1):
        monkeypatch.setattr(packing, "RANK_ROWS", rows)
        got = sorted(map(tuple, packing.pack_lengths(lengths, 16).collect()))
        assert want in (None, got) and len(got) == 200
        want = got


def test_packing_of_tables(spark, odd_docs, monkeypatch):
    monkeypatch.setattr(packing, "RANK_ROWS", 2)  # ranks of one length over several partitions
    docs = spark.createDataFrame([(i, prose(i % 7, 1 + i % 50)) for i in range(60)], "doc_id bigint, text string").unionByName(odd_docs.select("doc_id", "text"))
    got = packing.pack(docs, 128).collect()
    tokens = [(r.doc_id, len(SP.encode(r.text or ""))) for r in docs.collect()]
    pieces = [min(128, n - s) for _, n in tokens for s in range(0, n, 128)]
    by_bin = {}
    for r in got:
        by_bin.setdefault(r.bin_id, []).append((r.bin_offset, r.piece_len))
    assert sorted(sum(n for _, n in b) for b in by_bin.values()) == naive_bfd(pieces, 128)
    assert sorted(by_bin) == list(range(len(by_bin)))
    for parts in by_bin.values():
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(parts), sorted(parts)[1:])) and min(parts)[0] == 0
    assert packing.pack(docs.limit(0)).count() == 0 and packing.pack(odd_docs).count() > 0
    with pytest.raises(ValueError):
        packing.pack(docs, 0).count()


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 20), st.data())
def test_bits_round_trip(bits, data):
    ids = np.array(data.draw(st.lists(st.integers(0, 2**bits - 1), max_size=50)), np.int64)
    packed = tokenbin.pack_ids(ids, bits)
    assert len(packed) == -(-len(ids) * bits // 8) and tokenbin.unpack_ids(packed, len(ids), bits).tolist() == ids.tolist()


def test_word_cache_gives_the_library_s_ids(monkeypatch):
    """Odd spaces and signs, words that share slots, and a cache that is emptied on the way."""
    monkeypatch.setattr(wordcache, "SLOT_BITS", 4)
    monkeypatch.setattr(wordcache, "CACHE_IDS", 500)
    r = random.Random(2)
    texts = ODD + ["".join(r.choice("abcdefgh et-*=/. \n\t▁éß漢") for _ in range(r.randint(0, 90))) for _ in range(300)] + [" ", "\n ", None, " a", "a \t b"]
    enc = wordcache.WordEncoder(MODEL)
    for _ in range(2):
        for k in range(0, len(texts), 40):
            part = texts[k : k + 40]
            for i, j, ids, n in enc(pa.array(part, pa.string())):
                assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [SP.encode(t or "") for t in part[i:j]]


def test_widths_and_bounds():
    assert [tokenbin.width(v) for v in (1, 2, 3, 32000, 32768, 32769)] == [1, 1, 2, 15, 15, 16]
    with pytest.raises(ValueError):
        tokenbin.pack_ids(np.array([8]), 3)


def test_token_binary_of_tables(spark, odd_docs):
    got = tokenbin.tokenise(odd_docs, block=64).collect()
    want = sorted((r.doc_id or -1, SP.encode(r.text or "")) for r in odd_docs.collect())
    assert sorted((r.doc_id or -1, tokenbin.unpack_ids(r.packed, r.n_tokens, r.bits).tolist()) for r in got) == want
    for r in got:  # any block by itself
        blocks = [tokenbin.read_block(bytes(r.packed), r.block_offsets, i, r.n_tokens, r.bits, 64).tolist() for i in range(len(r.block_offsets) - 1)]
        assert sum(blocks, []) == tokenbin.unpack_ids(r.packed, r.n_tokens, r.bits).tolist() and r.block_offsets[-1] == len(r.packed)
    again = tokenbin.token_ids(tokenbin.tokenise(odd_docs)).collect()
    assert sorted((r.doc_id or -1, list(r.ids)) for r in again) == want
    assert tokenbin.tokenise(odd_docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        tokenbin.tokenise(odd_docs, block=7)


def test_token_binary_of_the_whole_table(spark, small_sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small_sf}/documents.parquet").select("doc_id", "text").collect()}
    got = tokenbin.op2_token_binary(spark, small_sf).collect()
    assert len(got) == len(docs) and all(tokenbin.unpack_ids(r.packed, r.n_tokens, r.bits).tolist() == SP.encode(docs[r.doc_id]) for r in got)


ODD = ["", "  ", "a  b", " lead", "trail ", "x\n\ny\n", "----------- ****** =========", "a▁b", "日本語のテキスト 한국어 😀😀", "q" * 500, "the\tthing  \n  indent\r\n", "\x00\x01abc", "▁/***/ ffffff ........", "\n" + "z" * 100]


@pytest.mark.parametrize("limit", [1 << 30, 0])  # by broadcast, by shuffle
def test_lattice_gives_the_library_s_ids(spark, odd_docs, limit):
    r = random.Random(1)
    texts = ODD + ["".join(r.choice("abcdefgh et-*=/. \n▁éß漢") for _ in range(r.randint(1, 80))) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").unionByName(odd_docs.select("doc_id", "text"))
    got = lattice.encode(docs, dictionary_bytes=limit).collect()
    key = lambda d, ids, text: (-1 if d is None else d, tuple(ids), text)
    want = sorted(key(x.doc_id, SP.encode(x.text or ""), (x.text or "").replace("▁", " ")) for x in docs.collect())
    assert sorted(key(x.doc_id, x.ids, x.decoded) for x in got) == want and all(x.n_tokens == len(x.ids) for x in got)
    assert lattice.encode(docs.limit(0), dictionary_bytes=limit).count() == 0 and lattice.encode(odd_docs, dictionary_bytes=limit).count() == odd_docs.count()


def test_decoding(spark):
    df = spark.createDataFrame([(1, SP.encode("some text, größer")), (2, []), (3, None), (4, [3 + 0xFF])], "doc_id bigint, ids array<int>")
    assert {r.doc_id: r.decoded for r in lattice.decode(df).collect()} == {1: "some text, größer", 2: "", 3: "", 4: "�"}


def test_decoding_refuses_unknown_ids(spark):
    frame = lambda ids: spark.createDataFrame([(1, ids)], "doc_id bigint, ids array<int>")
    ids = SP.encode("text")
    assert lattice.decode(frame([None, *ids, None])).first().decoded == "text" and lattice.decode(frame([None])).first().decoded == ""
    for bad in ([-1], [*ids, SP.vocab_size()]):
        with pytest.raises(Exception, match="ids must be"):
            lattice.decode(frame(bad)).collect()


def test_long_words_are_cut_where_no_piece_goes_across():
    t = lattice.table(MODEL)
    text = " " + "".join(chr(0x4E00 + i * 7 % 5000) for i in range(400)) + "wordswithoutspaces" * 20
    data = np.frombuffer(text.encode(), np.uint8)
    start, end, owner = lattice.segments(data, np.array([0, len(data)]), t)
    parts = [data[a:b].tobytes().decode() for a, b in zip(start, end)]
    assert "".join(parts) == text and not owner.any() and max(len(p) for p in parts if ord(p[-1]) > 127) <= lattice.MASK_CHARS
    assert not any(a[-1] + b[0] in p for a, b in zip(parts, parts[1:]) for p in t.scores)


def test_texts_by_viterbi(spark, odd_docs):
    """Whole texts come back exactly, and no word has a segmentation of a greater sum."""
    t = lattice.table(MODEL)
    texts = [x for x in ODD if len(x) < 300] + [prose(i, 20) for i in range(10)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").unionByName(odd_docs.where("doc_id in (2, 3, 4, 8, 9)").select("doc_id", "text"))
    got = lattice.encode(docs, fold="viterbi").collect()
    assert sorted((r.doc_id, r.decoded) for r in got) == sorted((r.doc_id, (r.text or "").replace("▁", " ")) for r in docs.collect())
    least, ids = min(t.scores.values()) - 10, {r.doc_id: r.ids for r in got}
    for i in range(len(texts) - 10, len(texts)):
        best = sum(best_sum(" " + w, t.scores, least)[0] for w in texts[i].split(" "))
        assert sum(t.all[x][1] for x in ids[i]) == pytest.approx(best)
    with pytest.raises(ValueError):
        lattice.encode(docs, fold="other")


def test_overtaking_pieces_are_few_and_words_without_them_need_one_pass():
    t = lattice.table(MODEL)
    risky = t.overtaking()
    assert len({p for p in risky if p.strip()}) < 50 and "----" in risky

    def once(word):
        edges = sorted((-t.scores[word[s : s + n]], s, n) for s in range(len(word)) for n in range(2, t.longest + 1) if word[s : s + n] in t.scores and s + n <= len(word))
        cuts = set(range(len(word) + 1))
        for _, s, n in edges:
            if {s, s + n} <= cuts and len([c for c in cuts if s < c < s + n]) == 1:
                cuts -= set(range(s + 1, s + n))
        at = sorted(cuts)
        return [word[a:b] for a, b in zip(at, at[1:])], any(word[s : s + n] in risky for _, s, n in edges)

    r = random.Random(3)
    for _ in range(3000):
        word = " " + "".join(r.choice("etaoinshrdlu-_*") for _ in range(r.randint(1, 14)))
        pieces, careful = once(word)
        if not careful:
            assert [p.replace("▁", " ") for p in SP.encode(word[1:], out_type=str)] == pieces


def best_sum(word, scores, unknown):
    found = {"": (0.0, ())}
    for end in range(1, len(word) + 1):
        options = []
        for start in range(end):
            piece = word[start:end]
            if piece in scores or end - start == 1:
                before = found[word[:start]]
                options.append((before[0] + scores.get(piece, unknown), (*before[1], end)))
        found[word[:end]] = max(options)
    return found[word]


def test_viterbi_takes_the_best_sum(spark):
    r = random.Random(5)
    scores = {"".join(r.choice("abc") for _ in range(n)): -r.uniform(1, 9) for n in (1, 2, 2, 3, 3, 3, 4) for _ in range(4)}
    pieces = spark.createDataFrame(list(scores.items()), "piece string, score double")
    words = sorted({"".join(r.choice("abcd") for _ in range(r.randint(1, 9))) for _ in range(150)})
    got = lattice.viterbi(spark.createDataFrame(list(enumerate(words)), "h bigint, word string"), pieces, 4, -20.0).collect()
    assert len(got) == len(words)
    for x in got:
        score, _ = best_sum(x.word, scores, -20.0)
        parts = [x.word[a:b] for a, b in zip([0, *x.ends], x.ends)]
        assert x.score == pytest.approx(score) and "".join(parts) == x.word and sum(scores.get(p, -20.0) for p in parts) == pytest.approx(score)


def test_query_encodes_the_whole_table(spark, small_sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small_sf}/documents.parquet").select("doc_id", "text").collect()}
    got = lattice.op10_sentencepiece(spark, small_sf).collect()
    assert len(got) == len(docs) and all(list(r.ids) == SP.encode(docs[r.doc_id]) and r.decoded == docs[r.doc_id] for r in got)
