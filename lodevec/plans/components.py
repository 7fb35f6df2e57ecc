"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodevec.runtime import discard, materialise


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: each node's greater neighbours go to its least neighbour. Small star: its lesser ones and itself do."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if large:
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        out = both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b")
    else:
        lesser = both.where("b < a")
        least = lesser.groupBy("a").agg(F.min("b").alias("m"))
        out = lesser.join(least, "a").select(F.col("m").alias("a"), "b").unionByName(least.select(F.col("m").alias("a"), F.col("a").alias("b")))
    return out.where("a <> b").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of the edge table (a, b); the component is its least node.

    Logarithmically many rounds of two shuffles of the edges; each round is written to the shared folder,
    so that the plan stays short and a lost executor costs one task; the files of the round before go. Self loops and repeated edges are
    allowed; an empty table gives an empty result; edges with a null end are ignored.
    """
    edges = edges.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    state = None
    for _ in range(max_rounds):
        old, edges = edges, materialise(_stars(_stars(edges, large=True), large=False), "components")
        discard(old)
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (now.n, now.h) == state:
            break
        state = (now.n, now.h)
    else:
        raise RuntimeError("connected_components did not converge")
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
