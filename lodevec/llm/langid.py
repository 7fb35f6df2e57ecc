"""Language identification: multinomial naive Bayes over hashed character n-grams.

The counts are taken over *all* labelled rows by Spark (languages x buckets, a size that does not
depend on the corpus); the matrix of log-probabilities travels with the scoring function, and a batch
is scored in numpy by gathering matrix rows and summing them over each text's n-grams. N-grams are of
characters (code points) of any script.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodevec.llm.textbytes import lower, runs
from lodevec.runtime import read_table

BUCKET_BITS = 17
BUCKETS = 1 << BUCKET_BITS
LENGTHS = (2, 3, 4)
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    """Whether each code point below U+10000 is a letter or a mark of one; at the end whether others are."""
    return np.array([unicodedata.category(chr(c))[0] in "LM" for c in range(1 << 16)] + [False])


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of texts of a run and the offsets into them; bytes that aren't UTF-8 give replacement characters."""
    try:
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        before = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        return points, before[offsets]
    except UnicodeDecodeError:
        texts = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:])]
        return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def ngrams(points: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """For each length the bucket of the n-gram at every character; BUCKETS where there is none.

    Characters other than letters count as a space, which may only be the first or the last of an n-gram.
    """
    n_points = len(points)
    letter = _letters()[np.minimum(points, 1 << 16)] | ((points >= 0x20000) & (points < 0x40000))  # the planes of ideographs
    d = np.zeros(n_points + 4, np.uint32)
    d[:n_points] = np.where(letter, points, 32)
    letters = np.zeros(n_points + 5, np.int32)
    letters[1 : n_points + 1] = np.cumsum(letter)
    letters[n_points + 1 :] = letters[n_points]
    end = np.repeat(offsets[1:], np.diff(offsets))
    at = np.arange(n_points)
    out, value = [], d[:n_points].copy()
    for n in range(2, max(LENGTHS) + 1):
        value = value * np.uint32(0x01000193) + d[n - 1 : n_points + n - 1]
        if n not in LENGTHS:
            continue
        inner = letters[at + n - 1] - letters[at + 1] == n - 2
        some = letters[at + n] > letters[at]
        mixed = (value ^ np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)) * np.uint32(0x9E3779B1)
        mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0xC2B2AE35)
        out.append(np.where(inner & some & (at + n <= end), (mixed >> np.uint32(32 - BUCKET_BITS)).astype(np.int64), BUCKETS))
    return out


@dataclass
class LanguageModel:
    """languages, and log-probabilities: one row a bucket and a last row of zeros, one column a language."""

    languages: list[str]
    log_probs: np.ndarray
    log_prior: np.ndarray

    def scores(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(log-likelihoods with the prior, number of n-grams) of each text."""
        k = len(self.languages)
        total, count = np.zeros((len(texts), k)), np.zeros(len(texts), np.int64)
        for i, j, data, offsets in runs(lower(texts)):
            points, offsets = code_points(data, offsets)
            full = np.flatnonzero(np.diff(offsets))
            if not len(full):
                continue
            starts = offsets[:-1][full]
            for buckets in ngrams(points, offsets):
                total[i + full] += np.add.reduceat(self.log_probs[buckets], starts, axis=0)
                count[i + full] += np.add.reduceat((buckets != BUCKETS).astype(np.int64), starts)
        return total + self.log_prior, count

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(number of the language or -1 for none known, its posterior) of each text.

        A text is of no known language if it has no letters, or if its n-grams are likelier when drawn
        evenly from all buckets than under any language.
        """
        if not self.languages or not len(texts):
            return np.full(len(texts), -1), np.zeros(len(texts))
        total, count = self.scores(texts)
        best = total.argmax(1)
        top = total.max(1)
        even = -count * np.log(BUCKETS)
        posterior = 1 / (np.exp(np.maximum(total - top[:, None], -700)).sum(1) + np.exp(np.clip(even - top, -700, 700)))
        return np.where((count > 0) & (top > even), best, -1), np.where(count > 0, posterior, 0.0)


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", smoothing: float = 0.1) -> LanguageModel:
    """Counts the n-grams of all rows with a language and a text, by language.

    What comes to the driver is at most languages x 2**17 counts. Rows with a null language or text
    are no examples. Without examples the model knows no language.
    """
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))

    def count(batches):
        counts: dict[str, np.ndarray] = {}
        texts_of: dict[str, int] = {}
        for b in batches:
            names = b.column(0).dictionary_encode()
            own, names = names.indices.to_numpy(zero_copy_only=False), names.dictionary.to_pylist()
            for x in names:
                counts.setdefault(x, np.zeros(BUCKETS + 1, np.int64))
            for x, n in zip(names, np.bincount(own, minlength=len(names))):
                texts_of[x] = texts_of.get(x, 0) + int(n)
            for i, j, data, offsets in runs(lower(b.column(1))):
                points, offsets = code_points(data, offsets)
                of_point = np.repeat(own[i:j].astype(np.int64), np.diff(offsets))
                for buckets in ngrams(points, offsets):
                    both = np.bincount(of_point * (BUCKETS + 1) + buckets, minlength=len(names) * (BUCKETS + 1)).reshape(len(names), -1)
                    for x, c in zip(names, both):
                        counts[x] += c
        for x, c in counts.items():
            c[BUCKETS] = 0
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([x] * (len(at) + 1)), pa.array(np.append(at, -1)), pa.array(np.append(c[at], texts_of[x]))], names=["lang", "bucket", "n"])

    found = rows.mapInArrow(count, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(found.column("lang").to_pylist()))
    number = {x: i for i, x in enumerate(names)}
    counts, texts_of = np.zeros((BUCKETS, len(names))), np.zeros(len(names))
    lang_no = np.array([number[x] for x in found.column("lang").to_pylist()], np.int64)
    bucket, n = found.column("bucket").to_numpy(), found.column("n").to_numpy()
    counts[bucket[bucket >= 0], lang_no[bucket >= 0]] = n[bucket >= 0]
    texts_of[lang_no[bucket < 0]] = n[bucket < 0]
    logs = np.log(counts + smoothing) - np.log(counts.sum(0) + smoothing * BUCKETS)
    return LanguageModel(names, np.vstack([logs, np.zeros(len(names))]).astype(np.float32), np.log(np.maximum(texts_of, 1) / max(1, texts_of.sum())))


def _verdict(model: LanguageModel):
    @F.arrow_udf("struct<lang:string,posterior:double>")
    def verdict(texts: pa.Array) -> pa.Array:
        best, posterior = model.predict(texts)
        names = pa.array([*model.languages, UNKNOWN])
        return pa.StructArray.from_arrays([names.take(pa.array(np.where(best < 0, len(model.languages), best))), pa.array(posterior)], ["lang", "posterior"])

    return verdict


def identify(docs: DataFrame, model: LanguageModel, accept: tuple[str, ...] | None = None, min_posterior: float = 0.5, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row for each document: doc_id, predicted_lang, posterior, keep.

    ``keep``: the language is one of ``accept`` (default: all that the model knows) and its posterior at
    least ``min_posterior``. Null, empty and letterless texts and texts unlike every known language get
    the language "und" and aren't kept. Of languages with equal scores the first by name is taken. Whole
    texts count, however long. Repeated rows give repeated rows, null keys stay null, an empty
    table gives an empty result, and other columns are neither read nor returned.
    """
    good = list(accept if accept is not None else model.languages)
    rows = docs.select(F.col(key).alias("doc_id"), _verdict(model)(F.col(text)).alias("v"))
    return rows.select("doc_id", F.col("v.lang").alias("predicted_lang"), F.col("v.posterior").alias("posterior"), (F.col("v.lang").isin(good) & (F.col("v.posterior") >= min_posterior)).alias("keep"))


def keep_known(docs: DataFrame, model: LanguageModel, accept: tuple[str, ...] | None = None, min_posterior: float = 0.5, text: str = "text") -> DataFrame:
    """The documents that ``identify`` keeps, with all their columns, in one pass without a shuffle.

    Null, empty and letterless texts go; repeated rows and rows with null keys are judged by their texts."""
    good = list(accept if accept is not None else model.languages)
    v = _verdict(model)(F.col(text))
    return docs.where(v["lang"].isin(good) & (v["posterior"] >= min_posterior))


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return identify(docs, fit(docs))
