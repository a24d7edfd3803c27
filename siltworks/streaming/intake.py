"""Incremental intake with Structured Streaming (an extension: recovery itself is a batch)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import fresh_path


def _stream(spark: SparkSession, folder: str, table: str) -> DataFrame:
    schema = spark.read.parquet(f"{folder}/{table}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(folder) if not _is_folder(spark, f"{folder}/{table}.parquet") else spark.readStream.schema(schema).parquet(f"{folder}/{table}.parquet")


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def drained(stream: DataFrame, name: str, mode: str) -> DataFrame:
    """Run ``stream`` over all that is there; each batch's folder is overwritten if the batch is repeated.

    In complete mode the last batch holds the result; otherwise all of them do.
    """
    spark = stream.sparkSession
    out, state = fresh_path(spark, name), fresh_path(spark, name + "-state")
    seen: list[int] = []

    def save(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/{n}")
        seen.append(n)

    stream.writeStream.foreachBatch(save).outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    if not seen:
        return spark.createDataFrame([], stream.schema)
    return spark.read.parquet(f"{out}/{max(seen)}" if mode == "complete" else f"{out}/*")


def windowed_counts(spark: SparkSession, folder: str, width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """(window_start, event_type, n) of the event stream in tumbling windows, or sliding ones."""
    events = _stream(spark, folder, "events")
    found = events.groupBy(F.window("ts", width, slide).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return drained(found.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n"), "windows", "complete")


def session_counts(spark: SparkSession, folder: str, gap: str) -> DataFrame:
    """(user_id, session_start, n): a session ends where a user's next event is ``gap`` away."""
    events = _stream(spark, folder, "events")
    found = events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return drained(found.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), "n"), "sessions", "complete")


def settled_counts(events: DataFrame, width: str, late: str) -> DataFrame:
    """(window_start, n) of a stream (ts, ...) whose state is bounded: a window is given out once the watermark, ``late`` behind the
    latest event, has passed its end; what comes later still is left out."""
    found = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w")).agg(F.count("*").alias("n"))
    return found.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "n")


def first_seen(rows: DataFrame, keys: list[str], late: str) -> DataFrame:
    """A stream (ts, keys, ...) without rows whose keys were seen within the watermark; older keys are forgotten."""
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def distinct_contents(spark: SparkSession, folder: str) -> DataFrame:
    """(digest): contents as they arrive, each once; the state is keyed by digest."""
    docs = _stream(spark, folder, "documents").where("text is not null").select(F.sha2("text", 256).alias("digest"))
    return drained(docs.dropDuplicates(["digest"]), "contents", "append")
