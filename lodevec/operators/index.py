"""A vector index and a text store over DataFrames: every change gives a new snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodevec.functions.vector import check_metric
from lodevec.operators.search import top_k_multi
from lodevec.runtime import materialise

#: Changes after which the items are written, so that the plan of a long-lived index stays short.
CHANGES = 8


class SearchIndex:
    """Items (id, embedding, metadata), each id once: adding replaces, removing is an anti-join.

    Ids are integers, or of another type that can be ordered if ``id_type`` names it.
    """

    def __init__(self, spark: SparkSession, metric: str = "cosine", items: DataFrame | None = None, id_type: str = "bigint", changes: int = 0):
        self.spark, self.metric, self.id_type = spark, check_metric(metric), id_type
        self.items = items if items is not None else spark.createDataFrame([], f"id {id_type}, embedding array<float>, metadata map<string,string>")
        self.changes = changes
        if changes >= CHANGES:
            self.items, self.changes = materialise(self.items, "index"), 0

    def _with(self, items: DataFrame) -> SearchIndex:
        return SearchIndex(self.spark, self.metric, items, self.id_type, self.changes + 1)

    def _ids(self, ids: DataFrame) -> DataFrame:
        return ids.select(F.col("id").cast(self.id_type).alias("id"))

    def add(self, rows: DataFrame) -> SearchIndex:
        """With the rows (id, embedding and perhaps metadata, a map); of rows with the same id one is taken."""
        meta = F.col("metadata") if "metadata" in rows.columns else F.lit(None).cast("map<string,string>")
        new = rows.where("id is not null").select(F.col("id").cast(self.id_type).alias("id"), F.col("embedding").cast("array<float>").alias("embedding"), meta.alias("metadata"))
        new = new.dropDuplicates(["id"])
        return self._with(self.items.join(new.select("id"), "id", "left_anti").unionByName(new))

    add_batch = add

    def remove(self, ids: DataFrame) -> SearchIndex:
        return self._with(self.items.join(self._ids(ids), "id", "left_anti"))

    def clear(self) -> SearchIndex:
        return SearchIndex(self.spark, self.metric, None, self.id_type)

    def get(self, ids: DataFrame) -> DataFrame:
        return self.items.join(self._ids(ids), "id", "left_semi")

    def size(self) -> int:
        return self.items.count()

    def search(self, queries: DataFrame, k: int = 10, threshold: float | None = None, where: Column | str | None = None, query_key: str = "query_id") -> DataFrame:
        """(query_id, rank, id, score, embedding, metadata): items filtered first, then scored, then cut by ``threshold``.

        ``where`` is a condition on the items' columns.
        """
        items = self.items if where is None else self.items.where(where)
        whole = isinstance(items.schema["id"].dataType, T.IntegralType)
        if not whole:  # numbers in the order of the ids, which decides ties
            items = materialise(items.orderBy("id").withColumn("__n", F.monotonically_increasing_id()), "numbered")
        found = top_k_multi(queries, items, k, self.metric, None, query_key, "id" if whole else "__n").withColumnRenamed("id", "__n")
        if threshold is not None:
            found = found.where(F.col("score") >= threshold)
        own = items.withColumn("__n", F.col("id").cast("bigint")) if whole else items
        return found.join(own, "__n").select("query_id", "rank", "id", "score", "embedding", "metadata")


class EmbeddingStore:
    """Texts by meaning: a provider of embeddings and an index. ``cache`` (max_size, ttl) keeps the texts that the driver embeds."""

    def __init__(self, spark: SparkSession, provider, metric: str = "cosine", index: SearchIndex | None = None, id_type: str = "bigint", cache: dict | None = None):
        from lodevec.sources.providers import with_cache

        self.provider, self.index = provider, index or SearchIndex(spark, metric, id_type=id_type)
        self.spark, self.metric = spark, metric
        self.near = with_cache(provider, **cache) if cache is not None else provider

    def _with(self, index: SearchIndex) -> EmbeddingStore:
        out = EmbeddingStore(self.spark, self.provider, self.metric, index)
        out.near = self.near
        return out

    def add_batch(self, rows: DataFrame) -> EmbeddingStore:
        """With rows (id, text and perhaps metadata, a map), which the workers embed, once: the items are read several times."""
        from lodevec.sources.providers import embed

        kept = ["id", "metadata"] if "metadata" in rows.columns else ["id"]
        return self._with(self.index.add(materialise(embed(rows, self.provider, keys=kept, input_type="document"), "embedded")))

    def add(self, key, text: str, metadata: dict[str, str] | None = None) -> EmbeddingStore:
        vector = self.near.embed([text], "document").embeddings[0]
        row = self.spark.createDataFrame([(key, vector, metadata)], f"id {self.index.id_type}, embedding array<float>, metadata map<string,string>")
        return self._with(self.index.add(row))

    def search_texts(self, queries: DataFrame, k: int = 10, threshold: float | None = None, where: Column | str | None = None) -> DataFrame:
        """(query_id, rank, id, score, embedding, metadata) for rows (query_id, text)."""
        from lodevec.sources.providers import embed

        return self.index.search(materialise(embed(queries, self.provider, keys=["query_id"], input_type="query"), "embedded"), k, threshold, where)

    def search(self, text: str, k: int = 10, threshold: float | None = None, where: Column | str | None = None) -> DataFrame:
        return self.search_by_embedding(self.near.embed([text], "query").embeddings[0], k, threshold, where)

    def search_by_embedding(self, vector: list[float], k: int = 10, threshold: float | None = None, where: Column | str | None = None) -> DataFrame:
        return self.index.search(self.spark.createDataFrame([(0, [float(x) for x in vector])], "query_id bigint, embedding array<float>"), k, threshold, where)

    def remove(self, ids: DataFrame) -> EmbeddingStore:
        return self._with(self.index.remove(ids))

    def clear(self) -> EmbeddingStore:
        return self._with(self.index.clear())

    def size(self) -> int:
        return self.index.size()
