"""Peaks and levels over a stream of signal chunks of any size; what a chunk leaves open stays as state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavespan.operators import levels


def peaks(chunks: DataFrame, base: int) -> DataFrame:
    """(rec, bucket, lo, hi) of a stream (rec, frame, cents)."""
    return chunks.groupBy("rec", F.floor(F.col("frame") / base).cast("long").alias("bucket")).agg(F.min("cents").alias("lo"), F.max("cents").alias("hi"))


def windows(chunks: DataFrame, window: int) -> DataFrame:
    """(rec, win, ss, n): the same exact sums as over a table."""
    return levels.windows(chunks, window)


def run_available(aggregate: DataFrame, keys: list[str], folder: str) -> DataFrame:
    """Runs a stream until its source is drained; the last row of each key.

    Each batch writes the rows that it changed into a folder by its number. A batch that is run again replaces its
    folder, so the result is the same after a loss.
    """
    schema = aggregate.schema

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{folder}/rows/{number}")

    query = aggregate.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    spark = aggregate.sparkSession
    rows = spark.read.option("recursiveFileLookup", "true").schema(schema.add("batch", "long")).parquet(f"{folder}/rows")
    others = [f.name for f in schema if f.name not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("last")).select(*keys, "last.*")
