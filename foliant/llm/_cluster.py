"""Shared helpers: tables cut out of the lineage, and block counts that follow the input."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The key that a null id counts as in orderings.
NULL_ID = -(2**63)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or (where unset, on one machine as in tests) a new local one."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="foliant-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def cut(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write df as Parquet in the shared folder and read it again, so that a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/foliant/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete tables that cut() wrote."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    for p in paths:
        where = hadoop.Path(p)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of plans nothing refers to any more."""
    for _ in range(2):  # plans hold others, which go with the next collection
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.3)


def give_back(spark: SparkSession) -> None:
    """Let executors' JVMs collect their garbage, and so shrink their heaps, which else keep the size that a stage before took."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("reflect('java.lang.System', 'gc')")).collect()


def fewer(df: DataFrame, together: int = 2) -> DataFrame:
    """df (of a shuffle's partitions), several partitions to a task, one after the other, unless cores would then be idle.

    Where Hadoop's native library is absent, each file and folder that a task writes to a local file system starts processes.
    """
    spark = df.sparkSession
    tasks = blocks_for(int(spark.conf.get("spark.sql.shuffle.partitions")), together)
    return df.coalesce(max(tasks, spark.sparkContext.defaultParallelism))


def column(df: DataFrame, name: str):
    """df's column by exact name (dots in names are literal)."""
    return df[f"`{name}`"]


def blocks_for(total_bytes: int, block_bytes: int) -> int:
    """How many blocks of about block_bytes hold total_bytes."""
    return max(1, -(-total_bytes // block_bytes))


def text_bytes(docs: DataFrame, name: str = "text") -> int:
    """Bytes of a text column, in one column-pruned scan."""
    return docs.agg(F.sum(F.octet_length(F.coalesce(column(docs, name), F.lit(""))))).first()[0] or 0


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Send texts to Python workers in batches that fit a small executor. This is the one setting that stays changed, as plans run later."""
    spark.conf.set(_BATCH, 1000)


@contextmanager
def batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs run within send batches of so many rows."""
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, rows)
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)
