"""Session plumbing shared by every operator: tables, shared storage, size-checked broadcasts, ranks."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A side of at most so many bytes may be broadcast; beyond it the shuffled plan is used.
BROADCAST_BYTES = 64 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder (a file or a folder of files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own, which goes when the process ends;
    on a cluster a missing setting is an error, since other executors can't read a machine's own folder.
    """
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if set_dir:
        return set_dir
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must be set for local-cluster")
    own = os.path.join(tempfile.gettempdir(), f"lodevec-{os.getpid()}")
    if not os.path.isdir(own):
        os.makedirs(own)
        atexit.register(shutil.rmtree, own, ignore_errors=True)
    return f"file://{own}"


def scratch(spark: SparkSession, label: str) -> str:
    """A new path below the application's own part of the shared folder; see ``clean``."""
    return f"{shared_dir(spark).rstrip('/')}/lodevec-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage of ``df``: write it as Parquet into the shared folder and read it back.

    The files outlive any executor, so a later read never recomputes or loses them.
    """
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    if _open:
        _open[-1].append(path)
    return out


_open: list[list[str]] = []


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """What is ``materialise``d inside is deleted at the end; results that read it must be written by then."""
    paths: list[str] = []
    _open.append(paths)
    try:
        yield
    finally:
        _open.remove(paths)
        for path in paths:
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(df: DataFrame | None) -> None:
    """Deletes the files of a ``materialise``d table that nothing reads any more."""
    if df is not None and getattr(df, "_scratch", None):
        _delete(df.sparkSession, df._scratch)


def clean(spark: SparkSession) -> None:
    """Deletes all that this application wrote into the shared folder; results that read it must be used up."""
    _delete(spark, f"{shared_dir(spark).rstrip('/')}/lodevec-{spark.sparkContext.applicationId}")


def broadcast_if_small(df: DataFrame, rows: int, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if ``rows * row_bytes`` fits ``limit``; else as it is (a shuffled join)."""
    return F.broadcast(df) if rows * row_bytes <= limit else df


def ranked(df: DataFrame, order: list[Column], column: str = "rank") -> DataFrame:
    """``df`` with its rows' places in a total order, from 1, without gathering them in one task.

    The rows are sorted over all tasks and written; a place is the row's number in its part and the rows
    of the parts before, of which there is one count a part.
    """
    part, number = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    rows = materialise(df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()), "ranked")
    parts = rows.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.select("__part", before.alias("__before"))
    return rows.join(F.broadcast(starts), part == F.col("__part")).withColumn(column, (F.col("__before") + number + 1).cast("int")).drop("__at", "__part", "__before")
