"""The corpus pipeline: toxicity, language, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's documents. What holds for all stages: an empty table gives an empty result,
repeated rows are judged by themselves, nulls in any column and columns of any other name are carried
along as they are, whole texts count however long they are, and the filters return the columns that they
were given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodevec.llm import langid, packing, simhash, toxicity
from lodevec.runtime import discard, read_table, scratch, temporary


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier calls toxic, those at the threshold too.

    Null, empty and wordless texts stay. Without a confirmed toxic label of these documents nothing goes.
    """
    return toxicity.drop_toxic(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels")))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose language isn't one of those in the column lang, or isn't clear.

    Null, empty and letterless texts go. Rows without a lang are no examples, but are judged; of languages
    with equal scores the first by name is taken.
    """
    return langid.keep_known(docs, langid.fit(docs))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: the one of the least doc_id, a null one last.

    Null, empty and wordless texts are in no group and stay. Rows are told apart by themselves, so that rows
    of one doc_id with different texts both stay and of repeated rows one does.
    """
    return simhash.drop_duplicates(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into training sequences: a row for each piece (see ``packing.pack``).

    Null and empty texts have no token and no row; pieces of equal length are ranked by the hash of doc_id and
    piece; documents with a null doc_id are packed too.
    """
    return packing.pack(docs)


STAGES = [("toxicity", toxicity_stage), ("language_id", language_stage), ("near_dedup", near_dedup_stage), ("best_fit_packing", packing_stage)]

#: Neither the learnt classifiers nor the packing can be written in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; what comes between is written to the shared folder."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with temporary(spark):  # a stage's own intermediate tables go when its result is written
            out, path = stage(spark, docs, sf_dir), scratch(spark, f"pipeline-{name}")
            out.write.parquet(path)
        discard(docs)
        docs = spark.read.schema(out.schema).parquet(path)
        docs._scratch = path
    return docs
