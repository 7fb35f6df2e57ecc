import random

import pytest

WORDS = "the of and river stone market winter garden paper engine silver morning teacher window forest music doctor island bridge letter summer village captain history kitchen mountain science".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "s", "ed", "ing", ","]) for _ in range(n))


CLASHING = "piece bigint, bin_id string, h string, word int, list string, votes string, count int, n_tokens string, fid int, lang2 string, component string, duplicate_of string, p_toxic string, keep string, a int, b int, __drop string, __again string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, clashing names."""
    names = [c.split()[0] for c in CLASHING.split(", ")]
    rows = [
        (1, prose(1, 60), "en", "s", 1), (1, prose(1, 60), "en", "s", 1), (2, None, "en", "s", None), (3, "", None, None, 0), (4, "  \n\t ", "en", "s", 4),
        (None, prose(2, 50), "en", None, 5), (5, prose(3, 50), None, "s", 5), (6, prose(6, 40_000), "en", "s", 9), (7, "x" * 300_000, "en", "s", 9), (8, "12 34 !!", "en", "s", 3), (None, None, None, None, None),
        (9, "ünïcode 漢字 😀 ▁mark\x00end", "fr", "s", 2),
    ]
    return spark.createDataFrame([(*r, *[None] * len(names)) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, " + CLASHING)


@pytest.fixture(scope="session")
def small_sf():
    return "/root/testdata/sf0.01"
