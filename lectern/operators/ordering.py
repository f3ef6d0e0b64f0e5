"""Places in an order over all rows, without bringing them into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import shared_folder


def numbered(rows: DataFrame, *order: str, name: str = "place") -> DataFrame:
    """``rows`` with their place from 1 by ``order``, which must tell rows apart: ranges are sorted apart and shifted by what stands before them."""
    spark, to = rows.sparkSession, shared_folder(rows.sparkSession)
    spread = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # written once, as ranges are drawn from a sample
    spread.select("*", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_i")).write.parquet(to)
    kept = spark.read.parquet(to)
    parts = kept.groupBy("_p").agg(F.count("*").alias("_n"))  # a row for each range
    before = parts.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))
    return kept.join(F.broadcast(before), "_p").withColumn(name, F.col("_before") + F.col("_i") + 1).drop("_p", "_i", "_before")
