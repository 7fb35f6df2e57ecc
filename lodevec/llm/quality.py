"""Document quality by weak supervision.

Rules over whole texts vote good (2), bad (1) or abstain (0). A two-coin Dawid-Skene model, fitted by
expectation-maximisation over the votes of *all* documents, estimates how often each rule is right on
good and on bad documents, without any label. A document is kept by its posterior probability of being
good rather than by passing every rule. The votes of a document are one number, so the fit needs just the
counts of the vote patterns (at most 3**rules, whatever the corpus holds).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodevec.llm.textbytes import LETTER, SPACE, Hasher, lower, mix, owners, runs, spans
from lodevec.runtime import materialise, read_table

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#$%&*<>=@[]^_`{}~\\/+|"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[ord("A") : ord("Z") + 1] = True

#: Agreement is what tells rules that are right from others, so each kind of junk is seen by two rules at least.
#: name: (feature, good from, good to, bad from, bad to); a value in neither range abstains.
RULES: dict[str, tuple[str, float, float, float, float]] = {
    "word_length": ("word_bytes", 2.5, 12, 20, np.inf),
    "symbols": ("symbols_a_word", 0, 0.05, 0.25, np.inf),
    "capitals": ("upper_share", 0, 0.25, 0.5, np.inf),
    "one_word": ("top_word_share", 0, 0.15, 0.3, np.inf),
    "repeats": ("repeat_share", 0, 0.05, 0.2, np.inf),
    "bars": ("bars_a_word", 0, 0.02, 0.2, np.inf),
    "shouting": ("shouts_a_word", 0, 0.05, 0.3, np.inf),
    "letters": ("letter_share", 0.85, 1, 0, 0.8),
    "phrases": ("pair_again_share", 0, 0.2, 0.4, 1),
    "words": ("words", 20, np.inf, 0, 0),
}
#: Rules on shares of words abstain on texts of fewer words.
FEW_WORDS = 20


def features(texts: pa.Array) -> dict[str, np.ndarray]:
    """The features of each text; a null counts as empty."""
    n = len(texts)
    out = {f: np.zeros(n) for f, *_ in RULES.values()}
    small = lower(texts)
    cased = list(runs(texts))
    for i, j, raw, at in cased:
        of = owners(at)
        count = lambda mask, of=of, m=j - i: np.bincount(of[mask], minlength=m)
        start, end, owner = spans(raw, at)
        words = np.bincount(owner, minlength=j - i)
        w = np.maximum(words, 1)
        letters = count(LETTER[raw])
        after = np.zeros(len(raw), bool)
        after[1:] = raw[:-1] == 0xC3
        upper = count(_UPPER[raw]) + count(after & (raw >= 0x80) & (raw <= 0x9E))
        ascii_letters = count(LETTER[raw] & (raw < 0x80)) + count(after & (raw >= 0x80))
        out["words"][i:j] = words
        out["word_bytes"][i:j] = np.bincount(owner, weights=end - start, minlength=j - i) / w
        out["symbols_a_word"][i:j] = count(_SYMBOL[raw]) / w
        out["upper_share"][i:j] = upper / np.maximum(ascii_letters, 1)
        out["bars_a_word"][i:j] = count(raw == ord("|")) / w
        out["shouts_a_word"][i:j] = count(raw == ord("!")) / w
        out["letter_share"][i:j] = letters / np.maximum(count(~SPACE[raw]), 1)
    for i, j, data, at in runs(small):
        start, end, owner = spans(data, at)
        if not len(start):
            continue
        words = np.bincount(owner, minlength=j - i)
        h = Hasher(data)(start, end, 5)
        again = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
        order = np.lexsort((h, owner))
        first = np.flatnonzero(np.append(True, (h[order][1:] != h[order][:-1]) | (owner[order][1:] != owner[order][:-1])))
        top = np.zeros(j - i)
        np.maximum.at(top, owner[order][first], np.diff(np.append(first, len(h))))
        out["repeat_share"][i:j] = np.bincount(owner[1:][again], minlength=j - i) / np.maximum(words, 1)
        out["top_word_share"][i:j] = top / np.maximum(words, 1)
        pair = np.flatnonzero(owner[1:] == owner[:-1])
        both, of = mix(h[pair] * np.uint64(0x9FB21C651E98DF25) + h[pair + 1]), owner[pair]
        order = np.lexsort((both, of))
        new = np.append(True, (both[order][1:] != both[order][:-1]) | (of[order][1:] != of[order][:-1]))[: len(order)]
        pairs = np.bincount(of, minlength=j - i)
        out["pair_again_share"][i:j] = 1 - np.bincount(of[order][new], minlength=j - i) / np.maximum(pairs, 1) - (pairs == 0)
    return out


def votes_of(texts: pa.Array) -> np.ndarray:
    """The votes of each text as one number to the base 3, the first rule lowest."""
    found, code = features(texts), np.zeros(len(texts), np.int64)
    few = found["words"] < FEW_WORDS
    for k, (feature, good_from, good_to, bad_from, bad_to) in enumerate(RULES.values()):
        x = found[feature]
        vote = np.where((x >= good_from) & (x <= good_to), 2, np.where((x >= bad_from) & (x <= bad_to), 1, 0))
        if feature in ("top_word_share", "repeat_share", "pair_again_share"):
            vote[few] = 0
        if feature != "words":
            vote[found["words"] == 0] = 0
        code += vote * 3**k
    return code


@dataclass
class VoteModel:
    """prior: share of good documents; right_good, right_bad: how often a voting rule is right on either kind."""

    prior: float
    right_good: np.ndarray
    right_bad: np.ndarray

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability of being good, by vote pattern; without any vote it is the prior."""
        votes = patterns[:, None] // 3 ** np.arange(len(self.right_good)) % 3
        good = np.log(self.prior) + (np.where(votes == 2, np.log(self.right_good), 0) + np.where(votes == 1, np.log1p(-self.right_good), 0)).sum(1)
        bad = np.log1p(-self.prior) + (np.where(votes == 1, np.log(self.right_bad), 0) + np.where(votes == 2, np.log1p(-self.right_bad), 0)).sum(1)
        return 1 / (1 + np.exp(np.clip(bad - good, -700, 700)))


def fit_votes(patterns: np.ndarray, counts: np.ndarray, rules: int = len(RULES), rounds: int = 200) -> VoteModel:
    """Expectation-maximisation from: most documents are good, and rules are mostly right on them.

    It begins with rules that wrongly accuse one good document in a hundred, for which they are made; a
    looser beginning ends with one kind of junk as the bad class and calls the others noise. Each rate has
    a Beta prior worth 100 good or 10 bad documents, which keeps it off 0 and 1 and the classes in place.
    """
    model = VoteModel(0.9, np.full(rules, 0.99), np.full(rules, 0.3))
    if not counts.sum():
        return model
    votes = patterns[:, None] // 3 ** np.arange(rules) % 3
    for _ in range(rounds):
        good = model.posterior(patterns) * counts
        bad = counts - good
        for_good, for_bad = votes == 2, votes == 1
        new = VoteModel(
            float((good.sum() + 9) / (counts.sum() + 10)),
            (good @ for_good + 99) / (good @ (for_good | for_bad) + 100),
            (bad @ for_bad + 3) / (bad @ (for_good | for_bad) + 10),
        )
        change = max(abs(new.prior - model.prior), np.abs(new.right_good - model.right_good).max(), np.abs(new.right_bad - model.right_bad).max())
        model = new
        if change < 1e-9:
            break
    return model


def vote_patterns(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, votes) of every document."""

    @F.arrow_udf("bigint")
    def votes(texts: pa.Array) -> pa.Array:
        return pa.array(votes_of(texts))

    return docs.select(F.col(key).alias("doc_id"), votes(F.col(text)).alias("votes"))


def assess(docs: DataFrame, threshold: float = 0.5, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row for each document: doc_id, votes (one digit a rule, to the base 3), p_quality, keep.

    Null and empty texts have one vote, that of the rule on the number of words, against them. Whole texts
    are judged, however long; a posterior that equals the threshold keeps. Repeated rows give repeated rows and count each, null keys stay null, an empty table gives an empty result,
    and other columns are neither read nor returned. Texts are read once; the fit and the look-up use
    the written votes.
    """
    rows = materialise(vote_patterns(docs, text, key), "votes")
    found = rows.groupBy("votes").count().toPandas()
    patterns = found["votes"].to_numpy(np.int64)
    model = fit_votes(patterns, found["count"].to_numpy(float))

    @F.arrow_udf("double")
    def posterior(votes: pa.Array) -> pa.Array:
        return pa.array(model.posterior(votes.to_numpy(zero_copy_only=False)))

    out = rows.withColumn("p_quality", posterior("votes"))
    return out.withColumn("keep", F.col("p_quality") >= threshold)


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    return assess(read_table(spark, sf_dir, "documents"))
