"""Toxicity: non-negative positive-unlabelled learning of a linear numpy classifier.

Only confirmed toxic examples and text whose label isn't looked at are used. The risk is that of Kiryo et al. (2017):
``prior * R_P(+1) + max(0, R_U(-1) - prior * R_P(-1))``, with a gradient step on the negative part
alone where it falls below zero. A text's features are its words, their beginnings and the 5-byte
n-grams within them, hashed; all of them count, however long the text is.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodevec.llm.textbytes import Hasher, lower, runs, spans
from lodevec.runtime import read_table

BUCKET_BITS = 20
BUCKETS = 1 << BUCKET_BITS
GRAM = 5
#: Bytes of the beginnings of words that are features, for languages that build words from parts.
BEGINNINGS = (6, 8)
#: Bounds of the sample of labelled rows that the classifier is fitted on: confirmed toxic ones, and ones taken without
#: their labels; and bytes of features that may come to the driver.
MAX_POSITIVE, MAX_UNLABELLED = 3000, 6000
MAX_FEATURE_BYTES = 192 << 20
SEED = 42
#: Standard errors by which a feature's shares must differ to be used.
SIGNIFICANT = 5.0
#: Weights under this share of the largest become 0, and their features needn't be counted.
PRUNE = 0.01


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, text number) of every word, beginning and n-gram of a run, and the number of words of each text."""
    start, end, owner = spans(data, offsets)
    n = len(offsets) - 1
    words = np.bincount(owner, minlength=n)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), words
    h = Hasher(data)
    shift = np.uint64(64 - BUCKET_BITS)
    whole = (h(start, end, 1) >> shift).astype(np.int64)
    grams = np.maximum(end - start - GRAM + 1, 0)
    last = np.cumsum(grams)
    at = np.repeat(start - (last - grams), grams) + np.arange(last[-1])
    inner = (h(at, at + GRAM, 2) >> shift).astype(np.int64)
    buckets, owners = [whole, inner], [owner, np.repeat(owner, grams)]
    for n in BEGINNINGS:
        long_ = np.flatnonzero(end - start > n)
        buckets.append((h(start[long_], start[long_] + n, 3) >> shift).astype(np.int64))
        owners.append(owner[long_])
    return np.concatenate(buckets), np.concatenate(owners), words


@dataclass
class ToxicModel:
    """A text's logit is bias + sum of its features' weights * sqrt(occurrences) / sqrt(number of words)."""

    weights: np.ndarray
    bias: float
    prior: float

    def probability(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros(len(texts))
        for i, j, data, offsets in runs(lower(texts)):
            bucket, owner, words = features(data, offsets)
            telling = np.flatnonzero(self.weights[bucket])
            both, n = np.unique(owner[telling] * BUCKETS + bucket[telling], return_counts=True)
            total = np.bincount(both >> BUCKET_BITS, weights=self.weights[both & (BUCKETS - 1)] * np.sqrt(n), minlength=j - i)
            logit = self.bias + total / np.sqrt(np.maximum(words, 1))
            out[i:j] = np.where(words > 0, 1 / (1 + np.exp(-np.clip(logit, -500, 500))), 0.0)
        return out


def nnpu(positive: list[tuple[np.ndarray, np.ndarray]], unlabelled: list[tuple[np.ndarray, np.ndarray]], prior: float, epochs: int = 100, batches: int = 4, rate: float = 0.05, decay: float = 1e-4) -> ToxicModel:
    """Fits weights by Adam on the non-negative risk with the logistic loss. Rows are (buckets, values).

    Features whose shares of positive and unlabelled rows differ by fewer than ``SIGNIFICANT`` standard
    errors are left out: with a million features, any that occurs in few positives would be fitted by
    chance. The others are scaled by the logarithm of the ratio of the shares.
    """
    rng = np.random.default_rng(SEED)
    rows = positive + unlabelled
    sizes = np.array([len(b) for b, _ in rows])
    at = np.concatenate([[0], np.cumsum(sizes)])
    flat = np.concatenate([b for b, _ in rows])
    used = np.flatnonzero(np.bincount(flat, minlength=BUCKETS))
    column = np.zeros(BUCKETS, np.int32)
    column[used] = np.arange(len(used), dtype=np.int32)
    col = column[flat]  # kept in 32 bits, as the values are: the sample is most of the driver's memory
    del flat
    cut = at[len(positive)]
    n_p, n_u = len(positive), len(unlabelled)
    in_p, in_u = np.bincount(col[:cut], minlength=len(used)), np.bincount(col[cut:], minlength=len(used))
    share = (in_p + in_u) / len(rows)
    error = np.sqrt(np.maximum(share * (1 - share), 1 / len(rows) ** 2) * (1 / n_p + 1 / n_u))
    ratio = np.log((in_p + 1) / (n_p + 1)) - np.log((in_u + 1) / (n_u + 1))
    ratio[np.abs(in_p / n_p - in_u / n_u) < SIGNIFICANT * error] = 0
    telling = ratio[col] != 0
    col, val = col[telling], np.concatenate([v for _, v in rows])[telling] * ratio[col[telling]]
    before = np.concatenate([[0], np.cumsum(telling)])
    sizes, at = before[at[1:]] - before[at[:-1]], before[at]
    w = np.zeros(len(used) + 1)  # the last is the bias
    m, v = np.zeros_like(w), np.zeros_like(w)
    step, mean, kept = 0, np.zeros_like(w), 0
    for epoch in range(epochs):
        parts = zip(np.array_split(rng.permutation(len(positive)), batches), np.array_split(len(positive) + rng.permutation(len(unlabelled)), batches))
        for p, u in parts:
            if not len(p) or not len(u):
                continue
            pick = np.concatenate([p, u])
            n = sizes[pick]
            last = np.cumsum(n)
            idx = np.repeat(at[pick] - (last - n), n) + np.arange(last[-1])
            c, x, row = col[idx], val[idx], np.repeat(np.arange(len(pick)), n)
            z = np.bincount(row, weights=w[c] * x, minlength=len(pick)) + w[-1]
            z = np.clip(z, -500, 500)
            s, loss = 1 / (1 + np.exp(-z)), np.logaddexp(0, z)  # the loss of calling it clean, whose slope is s
            d = np.zeros(len(pick))
            if loss[len(p) :].mean() >= prior * loss[: len(p)].mean():
                d[: len(p)] = -prior / len(p)  # prior * (slope of calling it toxic - slope of calling it clean)
                d[len(p) :] = s[len(p) :] / len(u)
            else:  # step back from the over-fitted negative part
                d[: len(p)] = prior * s[: len(p)] / len(p)
                d[len(p) :] = -s[len(p) :] / len(u)
            g = np.append(np.bincount(c, weights=d[row] * x, minlength=len(used)), d.sum()) + decay * np.append(w[:-1], 0) / len(pick)
            step += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            if epoch >= epochs // 2:  # the mean of the later steps is steadier than the last one
                mean += w
                kept += 1
    w = mean / max(kept, 1)
    weights = np.zeros(BUCKETS)
    weights[used] = w[:-1] * ratio
    weights[np.abs(weights) < PRUNE * np.abs(weights).max()] = 0
    bias = float(w[-1])
    return ToxicModel(weights, bias, prior)


def _below(share: float, seed: int = SEED):
    """About that share of the keys, by their hash."""
    return F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) < int(min(1.0, share) * (1 << 30))


def fit(docs: DataFrame, labels: DataFrame, prior: float | None = None, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED, text: str = "text", key: str = "doc_id", toxic: str = "toxic") -> ToxicModel:
    """Fits on a bounded sample of the rows of ``labels`` (key, toxic): about ``max_positive`` confirmed toxic documents, and
    about ``max_unlabelled`` documents of all its rows, whose labels are not looked at.

    The second part stands for unlabelled text: it's drawn from the population whose share of toxic rows is
    ``prior`` (by default the share among the labels). A key with contradicting labels counts as toxic; rows
    that repeat a key count once, but documents that share one are all examples. Null keys, labels and texts,
    and texts without words, are ignored; texts are read whole, however long, and longer ones make the sample
    smaller where its features would exceed ``MAX_FEATURE_BYTES``. Without examples nothing is toxic.
    """
    none = ToxicModel(np.zeros(BUCKETS), -500.0, 0.0)
    docs = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    labels = labels.where(F.col(key).isNotNull() & F.col(toxic).isNotNull()).groupBy(F.col(key).alias("doc_id")).agg(F.max(F.col(toxic).cast("int")).alias("toxic"))
    seen = labels.agg(F.count("*").alias("n"), F.sum("toxic").alias("bad")).first()
    if not seen.n or not seen.bad:
        return none
    prior = seen.bad / seen.n if prior is None else prior
    # the sample is bounded by the parameters, so that what is broadcast and what comes to the driver don't grow with the corpus
    good = labels.where("toxic = 1").where(_below(max_positive / seen.bad)).select("doc_id", F.lit(1).alias("y"))
    other = labels.where(_below(max_unlabelled / seen.n, SEED + 1)).select("doc_id", F.lit(0).alias("y"))
    sample = docs.join(F.broadcast(good.unionByName(other)), "doc_id").select("text", "y")
    size = sample.agg(F.coalesce(F.sum(F.octet_length("text").cast("bigint")), F.lit(0))).first()[0] * 8  # a byte of text gives about so many of features
    if size > MAX_FEATURE_BYTES:
        sample = sample.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int(MAX_FEATURE_BYTES / size * (1 << 30)))

    def rows(batches):
        for b in batches:
            ys = b.column(1).to_numpy(zero_copy_only=False)
            y, buckets, values = [], [], []
            for i, j, data, offsets in runs(lower(b.column(0))):
                bucket, owner, words = features(data, offsets)
                both, n = np.unique(owner * BUCKETS + bucket, return_counts=True)
                cut = np.searchsorted(both, np.arange(j - i + 1) * BUCKETS)
                for k in range(j - i):
                    if cut[k + 1] > cut[k]:
                        y.append(int(ys[i + k]))
                        buckets.append((both[cut[k] : cut[k + 1]] - k * BUCKETS).astype(np.int32))
                        values.append(np.sqrt(n[cut[k] : cut[k + 1]] / words[k]).astype(np.float32))
            if y:
                yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(buckets, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))], names=["y", "buckets", "vals"])

    found = sample.mapInArrow(rows, "y int, buckets array<int>, vals array<float>").toArrow()
    ys = found.column("y").to_numpy() if len(found) else np.zeros(0)
    parsed = []
    for name in ("buckets", "vals"):
        column = found.column(name).combine_chunks()
        flat, offsets = column.flatten().to_numpy(), np.asarray(column.offsets) - (column.offsets[0].as_py() if len(column) else 0)
        parsed.append([flat[offsets[i] : offsets[i + 1]] for i in range(len(column))])
    pairs = sorted(zip(ys, *parsed), key=lambda r: (-r[0], len(r[1]), r[1].tobytes()))  # an order that doesn't depend on the partitions
    positive, unlabelled = [(b, v) for y, b, v in pairs if y == 1], [(b, v) for y, b, v in pairs if y == 0]
    if not positive or not unlabelled:
        return none
    return nnpu(positive, unlabelled, float(min(max(prior, 1e-3), 0.9)))


def _probability(model: ToxicModel):
    weights, bias, prior = model.weights.astype(np.float32), model.bias, model.prior

    @F.arrow_udf("double")
    def probability(texts: pa.Array) -> pa.Array:
        return pa.array(ToxicModel(weights, bias, prior).probability(texts))

    return probability


def score(docs: DataFrame, model: ToxicModel, threshold: float = 0.5, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row for each document: doc_id, p_toxic, toxic (p_toxic >= threshold).

    Null, empty and wordless texts have p_toxic 0. Whole texts are scored, however long; p_toxic equal to
    the threshold is toxic. Repeated rows give repeated rows, null keys stay null, an empty table gives an empty result, and other columns are neither read nor returned.
    """
    rows = docs.select(F.col(key).alias("doc_id"), _probability(model)(F.col(text)).alias("p_toxic"))
    return rows.withColumn("toxic", F.col("p_toxic") >= threshold)


def drop_toxic(docs: DataFrame, model: ToxicModel, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """The documents that ``score`` doesn't call toxic, with all their columns, without a shuffle.

    Null, empty and wordless texts stay, as do repeated rows and rows with null keys."""
    return docs.where(_probability(model)(F.col(text)) < threshold)


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return score(docs, fit(docs, read_table(spark, sf_dir, "labels")))
