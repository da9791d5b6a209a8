"""Pieces that several text operators share."""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words, as a Java class: blank and U+0009 to U+000D.
SPACES = "[ \\t-\\r]+"
NOT_SPACES = "[^ \\t-\\r]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once per row, however often body uses it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Words in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def word_count(text: Column) -> Column:
    """How many words, long; 0 for null."""
    return F.size(words_of(text)).cast("long")


def with_checkpoints(spark: SparkSession) -> None:
    """Checkpoints go where the session says; a local session that names no folder gets a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="loxo-checkpoint-")
        sc.setCheckpointDir(folder)


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written to the shared checkpoint folder; its lineage ends there."""
    with_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """df, written as Parquet into the shared checkpoint folder and read again; smaller than a checkpoint where columns repeat.  The files go when the driver's Python ends."""
    spark = df.sparkSession
    with_checkpoints(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(removed, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared store, if it still can be reached."""
    with contextlib.suppress(Exception):  # the session may be gone, and its folder with it
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """Within it, what is planned and run hands Python at most ``rows`` rows at a time, for rows that hold whole texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def release(spark: SparkSession) -> None:
    """Lets Spark drop shuffle files of plans that nothing refers to any more; it finds them when the JVM collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: What lets go of what an operator keeps in a Python worker from task to task, by operator.
KEPT: dict[str, Callable[[], None]] = {}


def let_go() -> None:
    """Called by an operator's tasks: what others have kept in this worker goes, as workers outlive the stage that filled them."""
    for drop in KEPT.values():
        drop()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
