"""Element-wise aggregates of vectors, by group: partial hash aggregation on (group, position)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodevec.errors import ValidationError
from lodevec.functions.vector import wide


def _pool(df: DataFrame, by: list[str], vector: str, how, extra: list[Column] = ()) -> DataFrame:
    rows = df.where(F.col(vector).isNotNull()).select(*by, *extra, F.posexplode(wide(vector)).alias("__pos", "__x"))
    flat = rows.groupBy(*by, "__pos").agg(how.alias("__v"), F.count("*").alias("__n"))
    pairs = F.array_sort(F.collect_list(F.struct("__pos", "__v", "__n")))
    out = flat.groupBy(*by).agg(pairs.alias("__p"))
    sizes = F.transform("__p", lambda p: p["__n"])
    even = F.array_min(sizes) == F.array_max(sizes)
    vec = F.when(even, F.transform("__p", lambda p: p["__v"]).cast("array<float>")).otherwise(F.raise_error(F.lit("vectors of a group differ in length")).cast("array<float>"))
    return out.where("__p is not null and size(__p) > 0").select(*by, vec.alias(vector), F.element_at(sizes, 1).alias("count"))


def average(df: DataFrame, by: list[str] | None = None, vector: str = "embedding") -> DataFrame:
    """Element-wise mean of each group (of all rows without ``by``): by, vector, count.

    Null vectors don't count, a group without vectors has no row; different lengths raise an error.
    """
    return _pool(df, by or [], vector, F.avg("__x"))


centroid = average


def max_pool(df: DataFrame, by: list[str] | None = None, vector: str = "embedding") -> DataFrame:
    return _pool(df, by or [], vector, F.max("__x"))


def min_pool(df: DataFrame, by: list[str] | None = None, vector: str = "embedding") -> DataFrame:
    return _pool(df, by or [], vector, F.min("__x"))


def weighted_average(df: DataFrame, weight: str, by: list[str] | None = None, vector: str = "embedding") -> DataFrame:
    """Sum of weight * vector over the sum of weights; a sum of 0 gives NaN. Null weights don't count."""
    w = F.col(weight).cast("double").alias("__w")
    total = F.sum("__w")
    share = F.when(total == 0, F.lit(float("nan"))).otherwise(F.try_divide(F.sum(F.col("__w") * F.col("__x")), total))
    return _pool(df.where(F.col(weight).isNotNull()), by or [], vector, share, [w])


def incremental_average(mean: Column | str, new: Column | str, count: Column | int) -> Column:
    """The mean of count + 1 vectors from that of count and a new one."""
    n = F.lit(count) if isinstance(count, int) else count
    return F.zip_with(wide(mean), wide(new), lambda a, x: a + (x - a) / (n + 1)).cast("array<float>")


def batch_incremental_average(means: DataFrame, batch: DataFrame, by: list[str], vector: str = "embedding") -> DataFrame:
    """(by, vector, count): running means (by, vector, count) joined with the sums of a batch, by group."""
    if not by:
        raise ValidationError("running means need a key")
    flat = means.where(F.col(vector).isNotNull()).select(*by, (F.posexplode(wide(vector))).alias("__pos", "__x"), "count")
    old = flat.select(*by, "__pos", (F.col("__x") * F.col("count")).alias("__s"), F.col("count").alias("__n"))
    new = batch.where(F.col(vector).isNotNull()).select(*by, F.posexplode(wide(vector)).alias("__pos", "__s")).withColumn("__n", F.lit(1))
    sums = old.unionByName(new).groupBy(*by, "__pos").agg(F.sum("__s").alias("__s"), F.sum("__n").alias("__n"))
    pairs = F.array_sort(F.collect_list(F.struct("__pos", F.try_divide("__s", "__n").alias("v"))))
    return sums.groupBy(*by).agg(F.transform(pairs, lambda p: p["v"]).cast("array<float>").alias(vector), F.max("__n").alias("count"))


def combine_embeddings(texts: DataFrame, provider, by: list[str] | None = None, how=average, text: str = "text") -> DataFrame:
    """Embeds the texts by a provider (see ``sources.providers``) and pools the vectors of each group."""
    from lodevec.sources.providers import embed

    return how(embed(texts, provider, text=text), by)
