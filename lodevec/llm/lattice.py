"""SentencePiece encoding and decoding as a relational lattice.

A text's words (a run of spaces and what follows it) are encoded once each. For every distinct word the
substrings of bounded length are exploded and equi-joined to the piece table; the edges that are found
are grouped by word, and a higher-order ``aggregate`` folds them into the word's segmentation:

* a *unigram* model: Viterbi, the segmentation of the greatest sum of scores;
* a *BPE* model, as the public model file is: its ids are defined by merges rather than by a best sum, so
  that Viterbi over its scores gives other ids than the library. The fold then takes the edges by score
  and removes the boundary inside an edge where the edge joins exactly two present pieces. One pass is
  exact unless a merge can make a better-scored edge possible; the few pieces for which that can happen
  are found from the piece table alone (``overtaking``), and words with such an edge are folded with one
  pass for each merge.

Words that don't fit the fold of merges are first cut between characters that follow each other in no piece,
which no merge can cross. The words' ids are then gathered for the whole texts.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as proto

from lodevec.llm.pieces import MODEL, slices
from lodevec.llm.textbytes import RUN_BYTES, Hasher, buffers
from lodevec.runtime import materialise, read_table

#: Words of more characters don't fit the bit mask of the fold of merges. They are cut where no piece holds two characters
#: side by side; what is still longer (one sign over and over) is encoded by the library, exactly too.
MASK_CHARS = 61
#: A dictionary of words of at most so many bytes travels to the workers; a larger one is joined by a shuffle.
DICTIONARY_BYTES = 192 << 20
#: Distinct words of a task of the lattice, about.
TASK_WORDS = 40_000
_SEEN_BITS = 20
_NONE = -9e18


class PieceTable:
    """The pieces of a model file; spaces stand for the space mark."""

    def __init__(self, path: str):
        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        self.bpe = model.trainer_spec.model_type == proto.TrainerSpec.BPE
        norm = model.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not norm.escape_whitespaces:
            raise ValueError("only models with an identity normaliser and a space before each text are known here")
        self.all = [(p.piece.replace("▁", " "), p.score, p.type) for p in model.pieces]
        kind = proto.ModelProto.SentencePiece
        self.scores = {p: s for p, s, t in self.all if t == kind.NORMAL}
        if any(" " in p.lstrip(" ") for p in self.scores):
            raise ValueError("a piece crosses a word's end")
        self.ids = {p: i for i, (p, _, t) in enumerate(self.all) if t == kind.NORMAL}
        self.byte_ids = np.array([i for i, (_, _, t) in enumerate(self.all) if t == kind.BYTE], np.int32)
        if len(self.byte_ids) != 256:
            raise ValueError("only models with byte pieces are known here")
        self.text = [bytes([int(p[3:5], 16)]) if t == kind.BYTE else p.encode() if t == kind.NORMAL else b"" for p, _, t in self.all]
        self.longest = max(map(len, self.scores))
        #: Pairs of characters that follow each other in some piece.
        self.pairs = np.array(sorted({(ord(a) << 32) | ord(b) for p in self.scores for a, b in zip(p, p[1:])}), np.int64)
        #: ASCII bytes below the space that no longer piece holds: words are cut around them.
        self.cuts = [b for b in range(32) if not any(chr(b) in p for p in self.scores if len(p) > 1)]

    def overtaking(self) -> set[str]:
        """The pieces that a merge of a lower score can make possible, and all pieces that share their score.

        ``meet(a, b, s)``: whether a and b can be neighbours when all merges above the score s are done; by
        recursion on which of them was formed last. All merges before the first overtaking one are in
        the order of scores, so that recursion is sound for it.
        """
        score = self.scores
        of = lambda x: 1.0 if len(x) == 1 else score.get(x, _NONE)

        @cache
        def meet(a: str, b: str, above: float) -> bool:
            if of(a) <= above or of(b) <= above:
                return False
            if len(a) == len(b) == 1:
                return True
            if of(a) <= of(b):
                s = of(a)
                return any(meet(a[:i], a[i:], s) and meet(a[i:], b, s) and score.get(a[i:] + b, _NONE) <= s for i in range(1, len(a)))
            s = of(b)
            return any(meet(b[:i], b[i:], s) and meet(a, b[:i], s) and score.get(a + b[:i], _NONE) <= s for i in range(1, len(b)))

        counts: dict[float, int] = {}
        for s in score.values():
            counts[s] = counts.get(s, 0) + 1
        out = {p for p, s in score.items() if counts[s] > 1 and len(p) > 1}
        for p, s in score.items():
            for i in range(1, len(p)):
                u, v = p[:i], p[i:]
                late = len(v) > 1 and _NONE < of(v) < s and of(u) > of(v)
                if late and any(meet(v[:j], v[j:], of(v)) and meet(u, v[:j], of(v)) and score.get(u + v[:j], _NONE) <= of(v) for j in range(1, len(v))):
                    out.add(p)
                late = len(u) > 1 and _NONE < of(u) < s and of(v) > of(u)
                if late and any(meet(u[:j], u[j:], of(u)) and meet(u[j:], v, of(u)) and score.get(u[j:] + v, _NONE) <= of(u) for j in range(1, len(u))):
                    out.add(p)
        return out

    def frame(self, spark: SparkSession, merges: bool = True) -> DataFrame:
        """(piece, rank, score, careful) of the pieces of two or more characters (of all for Viterbi)."""
        risky = self.overtaking() if merges else set()
        order = sorted(self.scores, key=lambda p: (-self.scores[p], self.ids[p]))
        scores = sorted(set(self.scores.values()), reverse=True)
        rank = {s: i for i, s in enumerate(scores)}
        rows = [(p, rank[self.scores[p]], float(self.scores[p]), p in risky) for p in order if len(p) > 1 or not merges]
        return spark.createDataFrame(rows, "piece string, rank bigint, score double, careful boolean")


@cache
def table(path: str) -> PieceTable:
    return PieceTable(path)


def word_spans(data: np.ndarray, offsets: np.ndarray, cuts: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text number) of the words of texts that each begin with a space.

    A word begins at a space that follows another byte, and before and after each byte of ``cuts``.
    """
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    kind = np.zeros(256, np.int8)
    kind[32] = 1
    kind[cuts] = 2
    k = kind[data]
    begin = (k == 2) | (k == 1)
    begin[1:] &= (k[1:] != 1) | (k[:-1] != 1)
    begin[1:] |= k[:-1] == 2
    begin[offsets[:-1][offsets[:-1] < len(data)]] = True
    start = np.flatnonzero(begin)
    return start, np.append(start[1:], len(data)), np.searchsorted(offsets, start, side="right") - 1


def segments(data: np.ndarray, offsets: np.ndarray, t: PieceTable) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``word_spans``, with long words cut between characters that no piece holds side by side."""
    start, end, owner = word_spans(data, offsets, t.cuts)
    long_ = np.flatnonzero(end - start > MASK_CHARS)
    if not len(long_):
        return start, end, owner
    cuts = []
    for i in long_.tolist():
        word = data[start[i] : end[i]]
        points = np.frombuffer(word.tobytes().decode("utf-8", "surrogateescape").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        first = np.flatnonzero((word & 0xC0) != 0x80)
        if len(points) <= MASK_CHARS or len(first) != len(points):
            continue
        pair = (points[:-1] << 32) | points[1:]
        at = np.minimum(np.searchsorted(t.pairs, pair), len(t.pairs) - 1)
        cuts.append(start[i] + first[1:][t.pairs[at] != pair])
    if not cuts:
        return start, end, owner
    new = np.concatenate(cuts)
    start = np.sort(np.concatenate([start, new]))
    return start, np.append(start[1:], len(data)), np.searchsorted(offsets, start, side="right") - 1


def spaced(texts: pa.Array) -> pa.Array:
    """Each text with a space before it and spaces for space marks; a null or empty text is empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    out = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), pc.replace_substring(texts, "▁", " "), pa.scalar(" ", pa.large_string()))
    return pc.if_else(pc.equal(pc.binary_length(texts), 0), pa.scalar("", pa.large_string()), out)


def _spaced_runs(texts: pa.Array, run_bytes: int = RUN_BYTES):
    """(first, last, bytes, offsets) of runs of whole texts with their spaces; a run at a time is copied."""
    for i, j in slices(texts, run_bytes):
        data, offsets = buffers(spaced(texts.slice(i, j - i)))
        yield i, j, data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _take_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    size = end - start
    stop = np.cumsum(size)
    flat = data[np.repeat(start - (stop - size), size) + np.arange(int(stop[-1]) if len(stop) else 0)]
    at = np.concatenate([[0], stop]).astype(np.int32)
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(at.tobytes()), pa.py_buffer(flat.tobytes()))


def distinct_words(docs: DataFrame, model: str = MODEL, text: str = "text") -> DataFrame:
    """(h, word) of the corpus's words, each once; h is the word's hash."""

    def words(batches):
        t = table(model)
        seen = np.zeros(1 << _SEEN_BITS, np.uint64)
        for b in batches:
            for _, _, data, offsets in _spaced_runs(b.column(0)):
                start, end, _ = segments(data, offsets, t)
                h, first = np.unique(Hasher(data)(start, end, 11), return_index=True)
                place = (h & np.uint64(len(seen) - 1)).astype(np.int64)
                new = seen[place] != h
                h, first = h[new], first[new]
                seen[place[new]] = h
                if len(h):
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), _take_spans(data, start[first], end[first])], names=["h", "word"])

    return docs.select(F.col(text).cast("string").alias("text")).where("text is not null and text <> ''").mapInArrow(words, "h bigint, word string").distinct()


def _bit(at: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), at.cast("int"))


def _merge(mask: Column, edge: Column) -> Column:
    """The boundaries after an edge (rank, start, length in 6 bits each for the last two) is tried."""
    start, length = F.shiftright(edge, 6).bitwiseAND(F.lit(63)), edge.bitwiseAND(F.lit(63))
    ends = _bit(start).bitwiseOR(_bit(start + length))
    inside = F.call_function("shiftleft", _bit(length - 1) - 1, (start + 1).cast("int"))
    joins = (mask.bitwiseAND(ends) == ends) & (F.bit_count(mask.bitwiseAND(inside)) == 1)
    return F.when(joins, mask.bitwiseAND(F.bitwise_not(inside))).otherwise(mask)


def edges(words: DataFrame, pieces: DataFrame, longest: int) -> DataFrame:
    """(h, word, n, edges, careful): the lattice of each word; an edge of one character at 0 is always there."""
    cut = words.select("h", "word", F.char_length("word").alias("n"))
    cut = cut.select("h", "word", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("s"))
    shortest = F.when(F.col("s") == 0, 1).otherwise(2)
    room = F.least(F.lit(longest), F.col("n") - F.col("s"))
    cut = cut.where(room >= shortest).select("h", "word", "n", "s", F.explode(F.sequence(shortest, room)).alias("len"))
    cut = cut.withColumn("piece", F.expr("substring(word, s + 1, len)"))
    # the piece table has the size of the vocabulary, whatever the corpus holds
    hit = cut.join(F.broadcast(pieces), "piece", "left").where("rank is not null or (s = 0 and len = 1)")
    edge = F.coalesce("rank", F.lit(0)) * 4096 + F.col("s") * 64 + F.col("len")
    return hit.groupBy("h", "word").agg(F.collect_list(edge).alias("edges"), F.max(F.coalesce("careful", F.lit(False))).alias("careful")).withColumn("n", F.char_length("word"))


def fold_merges(lattice: DataFrame) -> DataFrame:
    """(h, word, mask): the boundaries that a BPE model's merges leave, as bits 0..n."""
    start = _bit(F.col("n") + 1) - 1
    by_rank = F.sort_array("edges")
    once = F.aggregate("sorted", start, _merge)

    def best(mask: Column, _: Column) -> Column:
        done = F.aggregate("sorted", mask, lambda now, e: F.when(now == mask, _merge(now, e)).otherwise(now))
        return done

    again = F.aggregate(F.sequence(F.lit(1), F.col("n")), start, best)
    return lattice.withColumn("sorted", by_rank).select("h", "word", F.when(F.col("careful"), again).otherwise(once).alias("mask"))


def viterbi(words: DataFrame, pieces: DataFrame, longest: int, unknown: float) -> DataFrame:
    """(h, word, score, ends): the segmentation of each word with the greatest sum of scores (a unigram model).

    ``words`` has the columns h, any number of the word's own, and word; a character that is no piece has the score ``unknown``. Edges are folded
    by their end; the state holds for each position the best score and the ends of the pieces so far.
    Of equal sums the longest last piece wins.
    """
    cut = words.select("h", "word", F.char_length("word").alias("n")).where("n > 0")
    cut = cut.select("h", "word", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("s"))
    cut = cut.select("h", "word", "n", "s", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.col("n") - F.col("s")))).alias("len"))
    cut = cut.withColumn("piece", F.expr("substring(word, s + 1, len)"))
    hit = cut.join(F.broadcast(pieces.select("piece", "score")), "piece", "left").where("score is not null or len = 1")
    edge = F.struct((F.col("s") + F.col("len")).alias("end"), F.col("s").alias("start"), F.coalesce("score", F.lit(unknown)).alias("score"))
    grouped = hit.groupBy("h", "word").agg(F.sort_array(F.collect_list(edge)).alias("edges"))
    kind = "array<struct<score:double,ends:array<int>>>"

    def step(best: Column, e: Column) -> Column:
        before = F.element_at(best, e["start"] + 1)
        now = F.struct((before["score"] + e["score"]).alias("score"), F.concat(before["ends"], F.array(e["end"])).alias("ends"))
        new = F.size(best) == e["end"]  # the first edge to its end: it opens the place
        better = F.element_at(best, -1)["score"] < now["score"]
        return F.when(new, F.concat(best, F.array(now))).when(better, F.concat(F.slice(best, F.lit(1), F.size(best) - 1), F.array(now))).otherwise(best).cast(kind)

    first = F.array(F.struct(F.lit(0.0).alias("score"), F.array().cast("array<int>").alias("ends"))).cast(kind)
    last = F.element_at(F.aggregate("edges", first, step), -1)
    return grouped.select("h", "word", last["score"].alias("score"), last["ends"].alias("ends"))


class _Ids:
    """Ids of the pieces of folded words, by the hash of their bytes."""

    def __init__(self, t: PieceTable):
        joined = pa.array(list(t.ids))
        data, offsets = buffers(joined)
        h = Hasher(data)(offsets[:-1], offsets[1:], 13)
        order = np.argsort(h)
        self.h, self.ids, self.byte_ids = h[order], np.array(list(t.ids.values()), np.int32)[order], t.byte_ids

    def __call__(self, words: pa.Array, mask: np.ndarray | None = None, ends: pa.ListArray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after another, number of each word) of words with the bits of their pieces' beginnings, or with their pieces' ends."""
        data, offsets = buffers(words)
        data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
        first = (data & 0xC0) != 0x80
        owner = np.repeat(np.arange(len(words)), np.diff(offsets))
        number = np.cumsum(first) - 1
        if ends is None:
            number -= np.append(number, 0)[offsets[:-1]][owner]
            start = np.flatnonzero(first & ((mask[owner] >> number) & 1).astype(bool))
        else:
            n = pc.list_value_length(ends).to_numpy(zero_copy_only=False)
            chars, base = np.append(np.flatnonzero(first), len(data)), number[offsets[:-1]]
            # a piece begins where the one before ends, the first one where its word does
            begin = np.concatenate([[0], ends.flatten().to_numpy()[:-1]])
            begin[np.cumsum(n) - n] = 0
            start = chars[np.repeat(base, n) + begin]
        end = np.append(start[1:], len(data))
        h = Hasher(data)(start, end, 13)
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        known = self.h[at] == h
        size = np.where(known, 1, end - start)
        stop = np.cumsum(size)
        out = np.repeat(np.where(known, self.ids[at], 0), size).astype(np.int32)
        raw = np.repeat(~known, size)
        place = np.repeat(start - (stop - size), size) + np.arange(len(out))
        out[raw] = self.byte_ids[data[place[raw]]]
        return out, np.bincount(owner[start], weights=size, minlength=len(words)).astype(np.int64)


@cache
def _ids(path: str) -> _Ids:
    return _Ids(table(path))


def _list_array(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(ids.astype(np.int32)))


def dictionary(docs: DataFrame, model: str = MODEL, text: str = "text", fold: str | None = None) -> DataFrame:
    """(h, word, ids) of every distinct word of the corpus; ``fold`` is "merges" or "viterbi", by default what the model is made for."""
    t = table(model)
    fold = fold or ("merges" if t.bpe else "viterbi")
    if fold not in ("merges", "viterbi"):
        raise ValueError(f"unknown fold {fold!r}")
    words = materialise(distinct_words(docs, model, text), "words")
    # a word becomes dozens of rows, so its tasks are cut by words rather than by bytes
    words = words.repartition(max(docs.sparkSession.sparkContext.defaultParallelism, -(-words.count() // TASK_WORDS)), "h", "word")
    schema = "h bigint, word string, ids array<int>"
    if fold == "viterbi":
        best = viterbi(words, t.frame(docs.sparkSession, False), t.longest, min(t.scores.values()) - 10)

        def of_ends(batches):
            find = _ids(model)
            for b in batches:
                out, n = find(b.column(1), ends=b.column(2))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _list_array(out, n)], names=["h", "word", "ids"])

        return materialise(best.select("h", "word", "ends").mapInArrow(of_ends, schema), "dictionary")
    short, long_ = F.char_length("word") <= MASK_CHARS, F.char_length("word") > MASK_CHARS
    folded = fold_merges(edges(words.where(short), t.frame(docs.sparkSession), t.longest))

    def ids(batches):
        find = _ids(model)
        for b in batches:
            out, n = find(b.column(1), b.column(2).to_numpy())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _list_array(out, n)], names=["h", "word", "ids"])

    def library(batches):
        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        newline = len(sp.encode("\n"))
        for b in batches:
            out = [sp.encode(w[1:]) if w[0] == " " else sp.encode("\n" + w)[newline:] for w in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.int32()))], names=["h", "word", "ids"])

    return materialise(folded.mapInArrow(ids, schema).unionByName(words.where(long_).mapInArrow(library, schema)), "dictionary")


def _decoded(t: PieceTable):
    sizes = np.array([len(x) for x in t.text], np.int64)
    flat, first = np.frombuffer(b"".join(t.text), np.uint8), np.cumsum(sizes) - sizes

    def decode(ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """The texts of lists of ids: their pieces without the space before the text."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(sizes)):
            raise ValueError(f"ids must be from 0 to {len(sizes) - 1}")
        size = sizes[ids]
        stop = np.cumsum(size)
        data = flat[np.repeat(first[ids] - (stop - size), size) + np.arange(int(stop[-1]) if len(stop) else 0)]
        at = np.concatenate([[0], stop])[offsets]
        lead = (at[:-1] < at[1:]) & (np.append(data, 0)[at[:-1]] == 32)
        keep = np.ones(len(data), bool)
        keep[at[:-1][lead]] = False
        at = at - np.concatenate([[0], np.cumsum(lead)])
        out = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64).tobytes()), pa.py_buffer(data[keep].tobytes())])
        try:
            return out.cast(pa.large_string()).cast(pa.string())
        except pa.ArrowInvalid:
            return pa.array([x.decode("utf-8", "replace") for x in out.to_pylist()])

    return decode


@cache
def _decoder(path: str):
    return _decoded(table(path))


def _flat_ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    counts = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat, offsets = column.flatten(), np.concatenate([[0], np.cumsum(counts)])
    if flat.null_count:
        there = flat.is_valid().to_numpy(zero_copy_only=False)
        offsets = np.concatenate([[0], np.cumsum(there)])[offsets]
        flat = flat.drop_null()
    return flat.to_numpy(zero_copy_only=False), offsets


def decode(encoded: DataFrame, model: str = MODEL, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """(doc_id, decoded) of rows with an array of ids. Null or empty arrays give empty texts, nulls within an
    array are left out, bytes that aren't UTF-8 give replacement characters, and an id outside the
    vocabulary, a negative one too, is an error. Arrays may be of any length; repeated rows and null keys stay."""

    def work(batches):
        turn = _decoder(model)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), turn(*_flat_ids(b.column(1)))], names=["doc_id", "decoded"])

    rows = encoded.select(F.col(key).alias("doc_id"), F.col(ids).cast("array<int>").alias("ids"))
    return rows.mapInArrow(work, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, decoded string")


def _packed(words: DataFrame) -> tuple[np.ndarray, ...] | None:
    """(hashes in order, first id, number of ids, ids) of a dictionary; None if two words share a hash.

    The workers pack it, so that 8 bytes a word, 2 for its length and 2 an id come to the driver.
    """

    def pack(batches):
        for b in batches:
            counts = pc.list_value_length(b.column(1)).to_numpy(zero_copy_only=False)
            columns = (b.column(0).to_numpy().view(np.uint64), counts.astype(np.uint32), b.column(1).flatten().to_numpy().astype(np.uint16))
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in columns], names=["h", "n", "flat"])

    found = words.select("h", "ids").mapInArrow(pack, "h binary, n binary, flat binary").toArrow()
    h, n, flat = (np.concatenate([np.zeros(0, kind), *(np.frombuffer(x.as_buffer(), kind) for x in found.column(c))]) for c, kind in (("h", np.uint64), ("n", np.uint32), ("flat", np.uint16)))
    del found
    order = np.argsort(h)
    h = h[order]
    if (h[1:] == h[:-1]).any():
        return None
    first = np.cumsum(n, dtype=np.uint32) - n
    return h, first[order], n[order], flat


def _by_broadcast(rows: DataFrame, words: DataFrame, model: str, kind: str) -> DataFrame | None:
    """The rows' ids by a dictionary that travels to the workers; None if it can't."""
    if len(table(model).all) > 1 << 16 or (packed := _packed(words)) is None:
        return None
    sent = rows.sparkSession.sparkContext.broadcast(packed)
    del packed

    def gather(batches):
        t = table(model)
        turn = _decoder(model)
        h, first, size, flat = sent.value
        for b in batches:
            for i, j, data, offsets in _spaced_runs(b.column(1)):
                start, end, owner = segments(data, offsets, t)
                own, back = np.unique(Hasher(data)(start, end, 11), return_inverse=True)
                at = np.searchsorted(h, own)
                n_own, first_own = size[at].astype(np.int64), first[at].astype(np.int64)
                n = n_own[back]
                stop = np.cumsum(n)
                ids = flat[np.repeat(first_own[back] - (stop - n), n) + np.arange(int(stop[-1]) if len(stop) else 0)].astype(np.int32)
                counts = np.bincount(owner, weights=n, minlength=j - i).astype(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(counts), _list_array(ids, counts), turn(ids, np.concatenate([[0], np.cumsum(counts)]))], names=["doc_id", "n_tokens", "ids", "decoded"])

    return rows.mapInArrow(gather, f"doc_id {kind}, n_tokens bigint, ids array<int>, decoded string")


def _by_shuffle(rows: DataFrame, words: DataFrame, model: str, kind: str) -> DataFrame:
    """The rows' ids by a shuffled join of their words with the dictionary."""

    def cut(batches):
        t = table(model)
        for b in batches:
            for i, j, data, offsets in _spaced_runs(b.column(1)):
                start, end, owner = segments(data, offsets, t)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i).take(pa.array(owner)), pa.array(start - offsets[owner]), pa.array(Hasher(data)(start, end, 11).view(np.int64)), _take_spans(data, start, end)], names=["row", "at", "h", "word"])

    numbered = materialise(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "rows")
    parts = numbered.select("row", "text").mapInArrow(cut, "row bigint, at bigint, h bigint, word string")
    joined = parts.join(words, ["h", "word"]).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("at", "ids"))).alias("parts"))
    found = numbered.select("row", "doc_id").join(joined, "row", "left").select("doc_id", F.coalesce(F.flatten("parts.ids"), F.array().cast("array<int>")).alias("ids"))

    def work(batches):
        turn = _decoder(model)
        for b in batches:
            flat, offsets = _flat_ids(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(offsets)), b.column(1), turn(flat, offsets)], names=["doc_id", "n_tokens", "ids", "decoded"])

    return found.mapInArrow(work, f"doc_id {kind}, n_tokens bigint, ids array<int>, decoded string")


def encode(docs: DataFrame, model: str = MODEL, text: str = "text", key: str = "doc_id", dictionary_bytes: int = DICTIONARY_BYTES, fold: str | None = None) -> DataFrame:
    """One row for each document: doc_id, n_tokens, ids, decoded.

    The ids are exactly the library's for the whole text, however long; with ``fold`` "viterbi" and a model of
    merges they are those of the greatest sum of its scores instead. ``decoded`` is what the ids decode to, which is
    the text (with a space for a literal space mark). A null or empty text has no id. Repeated rows give
    repeated rows, null keys stay null, an empty table gives an empty result, and other columns are
    neither read nor returned. The dictionary of distinct words grows with the corpus: up to
    ``dictionary_bytes`` it travels to the workers, beyond that the words are joined to it by a shuffle.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    words = dictionary(rows, model, fold=fold)
    size = words.agg(F.coalesce(F.sum(F.lit(16) + F.size("ids") * 2), F.lit(0))).first()[0]
    out = _by_broadcast(rows, words, model, kind) if size <= dictionary_bytes else None
    return _by_shuffle(rows, words, model, kind) if out is None else out


def op10_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return encode(read_table(spark, sf_dir, "documents"))


def sentencepiece_viterbi(spark, sf_dir: str) -> DataFrame:
    """The documents' ids by Viterbi over the scores of the pieces."""
    return encode(read_table(spark, sf_dir, "documents"), fold="viterbi")
