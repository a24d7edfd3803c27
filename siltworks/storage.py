"""Tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when it was counted and has at most this many (short) rows.
BROADCAST_ROWS = 500_000


#: Payloads go to the Python workers in Arrow batches of at most so many rows and bytes, whatever a task's share is.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


#: Rows of a task where tables of any size are joined and grouped.
TASK_ROWS = 500_000


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]):
    """What is executed within has these settings; the session's own come back after it."""
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def small_batches(spark: SparkSession):
    """What is executed within has Arrow batches of ``BATCH``."""
    return settings(spark, BATCH)


def tasks_by_rows(spark: SparkSession, rows: int):
    """What is executed within has a task for each ``TASK_ROWS`` of so many rows, which keeps the memory of a task whatever the table's
    size is; partitions are not joined again by their compressed bytes, nor are files read many at a time."""
    tasks = max(spark.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))
    return settings(spark, {"spark.sql.shuffle.partitions": str(tasks), "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.maxPartitionBytes": "8m"})


def workspace(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only under a local master that names none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="siltworks-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/recovery-{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{workspace(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table read back: short lineage that a lost executor doesn't undo."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint for a table (already written) that was found small enough; otherwise a shuffled join is left."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
