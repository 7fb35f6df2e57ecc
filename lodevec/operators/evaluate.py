"""Retrieval evaluation of many queries at once.

``results``: query_id, rank (1 is best), id. ``qrels``: query_id, id, relevance. Queries that only one side
has count too: without results or without judgements a measure is 0. Where many queries share their
judgements, ``topics`` (query_id, topic) names the topic of each query, and ``qrels`` are topic, id, relevance,
so that no row is made for each query and judgement.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def evaluate(results: DataFrame, qrels: DataFrame, k: int | None = None, topics: DataFrame | None = None) -> DataFrame:
    """(query_id, recall, ndcg, mrr, ap): recall and NDCG at k, reciprocal rank and average precision of all results.

    Relevant are judgements above 0. Gain 2**relevance - 1, discount log2(rank + 1); the ideal ranking is cut
    at k, at the number of results and at that of judgements. Repeated results count each. A query without a topic
    has no judgement, one with a topic that has none neither.
    """
    results = results.select("query_id", "rank", "id")
    if topics is None:
        qrels = qrels.withColumnRenamed("query_id", "topic")
        found = results.withColumn("topic", F.col("query_id"))
    else:
        topics = topics.select("query_id", "topic")
        found = results.join(topics, "query_id", "left")
    judged = qrels.groupBy("topic", "id").agg(F.max("relevance").cast("double").alias("rel"))
    cut = F.lit(k) if k is not None else F.lit(2**31 - 1)
    found = found.join(judged, ["topic", "id"], "left")
    hit = F.coalesce(F.col("rel") > 0, F.lit(False)).cast("int")
    running = F.sum(hit).over(Window.partitionBy("query_id").orderBy("rank", "id").rowsBetween(Window.unboundedPreceding, 0))
    found = found.withColumn("hit", hit).withColumn("hits", running)
    gain = (F.pow(F.lit(2.0), F.coalesce("rel", F.lit(0.0))) - 1) / F.log2(F.col("rank") + 1.0)
    per = found.groupBy("query_id").agg(
        F.sum(F.when(F.col("rank") <= cut, F.col("hit")).otherwise(0)).alias("top_hits"),
        F.sum(F.when(F.col("rank") <= cut, gain).otherwise(0.0)).alias("dcg"),
        F.max(F.when(F.col("hit") == 1, 1.0 / F.col("rank"))).alias("rr"),
        F.sum(F.when(F.col("hit") == 1, F.col("hits") / F.col("rank"))).alias("precision_sum"),
        F.count("*").alias("n_results"),
    )
    # the ideal ranking: no more of a topic's judgements than any query has results, picked before the shuffle
    most = k if k is not None else results.groupBy("query_id").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    place = F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("rel"), "id"))
    top = judged.withColumn("place", place).where(F.col("place") <= most).groupBy("topic").agg(F.sort_array(F.collect_list(F.struct("place", "rel"))).alias("best"))
    wanted = judged.groupBy("topic").agg(F.sum((F.col("rel") > 0).cast("int")).alias("n_rel")).join(top, "topic", "left")
    if topics is None:
        wanted = wanted.withColumnRenamed("topic", "query_id")
    else:
        wanted = topics.join(wanted, "topic").drop("topic")
    both = per.join(wanted, "query_id", "full")
    within = F.filter("best", lambda x: x["place"] <= F.coalesce("n_results", F.lit(0)))
    idcg = F.aggregate(within, F.lit(0.0), lambda s, x: s + (F.pow(F.lit(2.0), x["rel"]) - 1) / F.log2(x["place"] + 1.0))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return both.select("query_id", zero(F.try_divide("top_hits", "n_rel")).alias("recall"), zero(F.try_divide(F.col("dcg"), idcg)).alias("ndcg"), zero(F.col("rr")).alias("mrr"), zero(F.try_divide("precision_sum", "n_rel")).alias("ap"))


def summary(measures: DataFrame) -> DataFrame:
    """The means over all queries."""
    return measures.agg(*[F.avg(c).alias(c) for c in ("recall", "ndcg", "mrr", "ap")], F.count("*").alias("queries"))
