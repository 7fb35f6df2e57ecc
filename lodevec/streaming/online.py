"""Structured Streaming versions of the incremental operators."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodevec.functions.vector import wide
from lodevec.operators.clustering import GreedyConfig, IncrementalClusterer
from lodevec.runtime import discard, materialise, scratch


def file_stream(spark: SparkSession, path: str, schema: T.StructType, files_a_batch: int | None = None) -> DataFrame:
    """A stream of a Parquet table (a file or a folder of files)."""
    reader = spark.readStream.schema(schema)
    if files_a_batch:
        reader = reader.option("maxFilesPerTrigger", files_a_batch)
    return reader.parquet(path if not path.endswith(".parquet") else path + "*")


def _finished(spark: SparkSession, stream: DataFrame, mode: str, by: list[str] | None = None) -> DataFrame:
    """All rows that a stream gives until its source is used up, from a table in the shared folder.

    In the mode update a batch gives the rows that it changed, and of rows with the same ``by`` the last counts.
    """
    base = scratch(spark, "stream")

    def keep(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{base}/out" if mode == "complete" else f"{base}/out/batch={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    if query.lastProgress is None:
        return spark.createDataFrame([], stream.schema)
    if mode != "update":
        return spark.read.schema(stream.schema).parquet(f"{base}/out")
    rows = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())])).parquet(f"{base}/out")
    last = rows.groupBy(*by).agg(F.max_by(F.struct(*[c for c in stream.columns if c not in by]), "batch").alias("last"))
    return last.select(*by, "last.*").select(*stream.columns)


def running_sums(stream: DataFrame, by: list[str], vector: str = "embedding") -> DataFrame:
    """(by, pos, total, n): the state of running means, a row for each position of each group."""
    return stream.where(F.col(vector).isNotNull()).select(*by, F.posexplode(wide(vector)).alias("pos", "x")).groupBy(*by, "pos").agg(F.sum("x").alias("total"), F.count("*").alias("n"))


def means_of(sums: DataFrame, by: list[str], vector: str = "embedding") -> DataFrame:
    pairs = F.array_sort(F.collect_list(F.struct("pos", F.try_divide("total", "n").alias("m"))))
    return sums.groupBy(*by).agg(F.transform(pairs, lambda p: p["m"]).cast("array<float>").alias(vector), F.max("n").alias("count"))


def averages(spark: SparkSession, path: str, schema: T.StructType, by: list[str], vector: str = "embedding") -> DataFrame:
    """Means of a table that is read as a stream, by group: (by, vector, count)."""
    return means_of(_finished(spark, running_sums(file_stream(spark, path, schema), by, vector), "complete"), by, vector)


def event_windows(spark: SparkSession, path: str, schema: T.StructType, length: str = "1 hour", late: str = "2 hours", files_a_batch: int | None = None) -> DataFrame:
    """(event_type, window_start, n, total) of events read as a stream.

    A batch gives the windows that it changed, and the state of a window goes when the watermark has passed
    its end: events that come later than ``late`` after a newer batch's are left out.
    """
    events = file_stream(spark, path, schema, files_a_batch).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = events.groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return _finished(spark, out.select("event_type", F.col("window.start").alias("window_start"), "n", "total"), "update", ["event_type", "window_start"])


def _assigned(df: DataFrame, clusterer: IncrementalClusterer, key: str, vector: str) -> DataFrame:
    """(key, cluster_id, vector, size) of the rows in the order of keys; at the end one row a cluster with its centroid and size, and no key."""
    rows = df.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key), F.col(vector).cast("array<float>").alias("v"))
    config, state = clusterer.config, clusterer.state()

    def work(batches):
        own = IncrementalClusterer(config)
        own.restore(*state)
        for pdf in batches:
            yield pdf[[key]].assign(cluster_id=np.array(own.add_batch(pdf["v"]), np.int64), centroid=None, size=None)
        now, sizes = own.state()
        yield pd.DataFrame({key: pd.Series([None] * len(sizes), dtype=object), "cluster_id": np.arange(len(sizes)), "centroid": list(now), "size": sizes})

    kind = rows.schema[key].dataType.simpleString()
    return rows.repartition(1).sortWithinPartitions(key).mapInPandas(work, f"`{key}` {kind}, cluster_id bigint, centroid array<float>, size bigint")


def cluster_batches(df: DataFrame, config: GreedyConfig, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, cluster_id) by the online clusterer over the rows in the order of keys.

    Each row's cluster depends on all rows before it, so that one task goes through them as a stream; it holds the centroids alone.
    """
    return _assigned(df, IncrementalClusterer(config), key, vector).where(F.col(key).isNotNull()).select(key, "cluster_id")


def cluster_stream(stream: DataFrame, clusterer: IncrementalClusterer, path: str, checkpoint: str, key: str = "vec_id", vector: str = "embedding"):
    """Starts a query that assigns each micro-batch's rows and appends them to a table (key, cluster_id) at ``path``.

    A task of the cluster goes through a batch's rows; the driver only keeps the clusterer's centroids and
    sizes, which it takes up from the batch's end. A batch that is repeated begins from the state it began
    from, which is written beside the table, and replaces itself.
    """

    def batch(df: DataFrame, number: int) -> None:
        before = f"{path}-state/batch={number}"
        own = df.sparkSession
        kinds = "cluster_id bigint, centroid array<float>, size bigint"
        if number:
            rows = own.read.schema(kinds).parquet(before).orderBy("cluster_id").collect()
            clusterer.restore(np.array([r.centroid for r in rows], np.float32), [r.size for r in rows])
        after, out = f"{path}-state/batch={number + 1}", materialise(_assigned(df, clusterer, key, vector), "assigned")
        out.where(F.col(key).isNotNull()).select(key, "cluster_id").write.mode("overwrite").parquet(f"{path}/batch={number}")
        out.where(F.col(key).isNull()).select("cluster_id", "centroid", "size").write.mode("overwrite").parquet(after)
        discard(out)
        rows = own.read.schema(kinds).parquet(after).orderBy("cluster_id").collect()
        clusterer.restore(np.array([r.centroid for r in rows], np.float32), [r.size for r in rows])

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
