"""Streaming forms of ingestion and of the attempt log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import content_id


def new_files(spark: SparkSession, path: str) -> DataFrame:
    """A stream of files, each content once."""
    kind = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.schema(kind).format("binaryFile").load(path)
    return files.select(content_id(F.col("content")).alias("id"), "path", "modificationTime", "content").withWatermark("modificationTime", "1 day").dropDuplicatesWithinWatermark(["id"])


def attempts_by_window(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Attempts and marks by section in event-time windows; rows later than ``late`` are left out."""
    w = F.window("answered_at", window)
    return events.withWatermark("answered_at", late).groupBy(w, "section").agg(F.count("*").alias("attempts"), F.sum("awarded").alias("awarded"), F.sum("most").alias("most"))


def upsert_latest(stream: DataFrame, table: str, checkpoint: str):
    """Keeps the last attempt at each question of a section in a Parquet folder, a version a batch; a repeated batch changes nothing.

    Batch n reads version n - 1, which it must find, and writes version n; older versions are deleted.
    """
    key = ["question", "section"]

    def put(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if batch_id > 0:
            batch = batch.unionByName(spark.read.parquet(f"{table}/v={batch_id - 1}").select(*batch.columns))
        rest = [c for c in batch.columns if c not in key]
        latest = batch.groupBy(*key).agg(F.max_by(F.struct(*rest), "id").alias("x")).select(*key, "x.*")
        latest.write.mode("overwrite").parquet(f"{table}/v={batch_id}")
        old = spark._jvm.org.apache.hadoop.fs.Path(f"{table}/v={batch_id - 2}")
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
