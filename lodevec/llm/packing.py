"""Best-fit-decreasing packing of tokenised documents into training sequences.

The placement of best fit decreasing depends on the lengths alone, and equal lengths and bins of
equal room are interchangeable. So the whole corpus is packed *globally and exactly* from its
histogram of lengths (at most ``capacity`` rows, whatever the corpus holds): a segment tree over
the remaining capacities finds the tightest open bin in logarithmic time, and every leaf holds
ranges of bins of that room, so that one step places a whole run of equally long documents. What
scales with the corpus - token counts, the rank of each piece among those of its length, the look-up
of its bin - is done by Spark.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodevec.llm.pieces import MODEL
from lodevec.llm.wordcache import encoder
from lodevec.runtime import materialise, read_table

#: Tokens of a training sequence.
CAPACITY = 2048
#: Pieces of one length that are ranked in one window partition, about; more are cut by ranges of their hashes.
RANK_ROWS = 200_000


class CapacityTree:
    """Segment tree over remaining capacities 1..capacity; a leaf holds ranges (first bin, bins)."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.open = [False] * (2 * self.size)
        self.ranges: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def _mark(self, c: int) -> None:
        i = c + self.size
        self.open[i] = bool(self.ranges[c])
        while i > 1:
            i >>= 1
            self.open[i] = self.open[2 * i] or self.open[2 * i + 1]

    def push(self, c: int, first: int, bins: int) -> None:
        if c > 0 and bins > 0:
            self.ranges[c].append((first, bins))
            if len(self.ranges[c]) == 1:
                self._mark(c)

    def pop(self, c: int) -> tuple[int, int]:
        out = self.ranges[c].pop()
        if not self.ranges[c]:
            self._mark(c)
        return out

    def tightest(self, need: int) -> int | None:
        """The least capacity >= need with an open bin."""
        i = need + self.size
        if self.open[i]:
            return need
        while i > 1:
            if not i & 1 and self.open[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.open[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return None


def plan_bins(histogram: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Best fit decreasing over a histogram of lengths.

    Returns runs (length, first rank, first bin, pieces a bin, offset in the bin), ordered by length
    and rank, and the number of bins: the piece of that length and of rank r >= first rank is in bin
    ``first bin + (r - first rank) // pieces``.
    """
    tree, runs, bins = CapacityTree(capacity), [], 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                opened = -(-left // (capacity // length))
                tree.push(capacity, bins, opened)
                bins += opened
                continue
            first, there = tree.pop(room)
            each = room // length
            if full := min(there, left // each):
                runs.append((length, rank, first, each, capacity - room))
                tree.push(room - each * length, first, full)
                rank, left, first, there = rank + full * each, left - full * each, first + full, there - full
            if there and 0 < left < each:
                runs.append((length, rank, first, each, capacity - room))
                tree.push(room - left * length, first, 1)
                rank, left, first, there = rank + left, 0, first + 1, there - 1
            tree.push(room, first, there)
    return np.array(sorted(runs), np.int64).reshape(-1, 5), bins


def token_counts(docs: DataFrame, model: str = MODEL, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_tokens) of every row; a null or empty text has 0 tokens."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))

    def count(batches):
        enc = encoder(model)
        for b in batches:
            n = [counts for _, _, _, counts in enc(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(n) if n else np.zeros(0, np.int64))], names=["doc_id", "n_tokens"])

    return rows.mapInArrow(count, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens bigint")


def pack_lengths(lengths: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Packs rows (doc_id, n_tokens), which should be materialised; see ``pack``."""
    if capacity < 1:
        raise ValueError("capacity must be positive")
    lengths = lengths.withColumn("__row", F.monotonically_increasing_id())
    pieces = lengths.where("n_tokens > 0").select(
        "doc_id", "__row", "n_tokens", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(n_tokens - 1) div {capacity}"))).alias("piece")
    )
    pieces = pieces.select(
        "doc_id", "__row", "piece", (F.col("piece") * capacity).alias("piece_start"), F.least(F.lit(capacity).cast("bigint"), F.col("n_tokens") - F.col("piece") * capacity).cast("int").alias("piece_len")
    )
    histogram = {r.piece_len: r["n"] for r in pieces.groupBy("piece_len").agg(F.count("*").alias("n")).collect()}
    runs, _ = plan_bins(histogram, capacity)

    # pieces of one length are ranked by hash, then key: ranges of the hash keep that order in any number of parts
    own = F.when(F.col("doc_id").isNull(), F.col("__row")).otherwise(F.lit(-1))  # null keys are alike but for their rows
    pieces = pieces.withColumn("hash", F.xxhash64("doc_id", "piece", own)).drop("__row")
    depth = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        depth[length] = max(0, int(np.ceil(np.log2(n / RANK_ROWS)))) if n else 0
    base = np.concatenate([[0], np.cumsum(1 << depth)])
    part = F.lit(0).cast("bigint")
    if hot := {k: int(depth[k]) for k in histogram if depth[k]}:
        bits = F.create_map(*[F.lit(x) for kv in hot.items() for x in kv])[F.col("piece_len")]
        half = F.call_function("shiftleft", F.lit(1).cast("bigint"), (bits - 1).cast("int"))
        part = F.when(bits.isNotNull(), F.call_function("shiftright", F.col("hash"), (64 - bits).cast("int")) + half).otherwise(part)
    pieces = pieces.withColumn("part", part)
    before = np.zeros(base[-1], np.int64)
    if hot:
        for r in pieces.where(F.col("piece_len").isin(*hot)).groupBy("piece_len", "part").agg(F.count("*").alias("n")).collect():
            before[base[r.piece_len] + r.part] = r["n"]
        for k, bits_k in hot.items():
            at = slice(base[k], base[k] + (1 << bits_k))
            before[at] = np.cumsum(before[at]) - before[at]
    keys = (runs[:, 0] << 40) + runs[:, 1]

    def place(batches):
        for b in batches:
            length, in_part, number = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (3, 5, 6))
            rank = before[base[length] + in_part] + number - 1
            at = np.searchsorted(keys, (length << 40) + rank, side="right") - 1
            _, first_rank, first_bin, each, offset = runs[at].T
            step = rank - first_rank
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in range(4)), pa.array(first_bin + step // each), pa.array((offset + step % each * length).astype(np.int32))],
                names=["doc_id", "piece", "piece_start", "piece_len", "bin_id", "bin_offset"],
            )

    order = Window.partitionBy("piece_len", "part").orderBy("hash", "doc_id", "piece")
    ranked = pieces.withColumn("number", F.row_number().over(order).cast("bigint"))
    kind = lengths.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(place, f"doc_id {kind}, piece bigint, piece_start bigint, piece_len int, bin_id bigint, bin_offset int")


def pack(docs: DataFrame, capacity: int = CAPACITY, model: str = MODEL, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Global best-fit-decreasing packing of all documents into sequences of ``capacity`` tokens.

    A document of more tokens than ``capacity`` is cut into full sequences and a rest, as in best-fit
    packing for language models. One row for each piece: doc_id, piece (from 0), piece_start (token of
    the document), piece_len, bin_id (from 0, without gaps) and bin_offset (token of the bin).

    Null or empty texts have no token and so no row; texts of any length are packed whole. Repeated rows
    are packed once each; pieces of one length are ranked by the hash of key and piece, then by these, at
    every size, so that where a document goes depends on the documents alone; null keys are packed too,
    but which of them goes where isn't defined. An empty table gives an empty result. Columns other than
    key and text are neither read nor returned, whatever their names.
    """
    return pack_lengths(materialise(token_counts(docs, model, text, key), "lengths"), capacity)


def op1_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))
