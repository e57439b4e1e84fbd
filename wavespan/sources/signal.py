"""Recordings as rows: a signal of (rec, frame, cents), here derived from the events table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wavespan.sources.files import shared_dir

SCHEMA = "rec string, frame long, cents long"
_STORED: dict[tuple, str] = {}


def events_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The signal of the events table, imported once an application into the shared folder; it goes when the driver ends.

    Queries read recordings, so they read the imported table and number no rows themselves.
    """
    context = spark.sparkContext
    key = context.applicationId, *sorted(spark.read.parquet(f"{sf_dir}/events.parquet").inputFiles())
    if key not in _STORED:
        path = f"{shared_dir(spark)}/wavespan/signal-{uuid.uuid4().hex}"
        numbered(spark, sf_dir).write.parquet(path)
        at = context._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(at)
        _STORED[key] = path
    return spark.read.schema(SCHEMA).parquet(_STORED[key])


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event type is a recording; its events in time order are frames, their values integer samples.

    Frames are numbered within hours; the hours' counts, a row for each hour of a type, give where an hour begins.
    """
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("rec"), F.date_trunc("hour", "ts").alias("hour"), "ts", "event_id", F.round(F.col("value") * 100).cast("long").alias("cents"))
    earlier = Window.partitionBy("rec").orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
    hours = events.groupBy("rec", "hour").agg(F.count(F.lit(1)).alias("n")).select("rec", "hour", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    numbered = events.withColumn("own", F.row_number().over(Window.partitionBy("rec", "hour").orderBy("ts", "event_id")) - 1)
    return numbered.join(hours, ["rec", "hour"]).select("rec", (F.col("first") + F.col("own")).cast("long").alias("frame"), "cents")


def totals(signal: DataFrame) -> DataFrame:
    return signal.groupBy("rec").agg(F.count(F.lit(1)).alias("total"))


def silence(spark: SparkSession, total: int) -> DataFrame:
    return spark.range(total).select(F.col("id").alias("frame"), F.lit(0).cast("long").alias("cents"))


def in_range(spark: SparkSession, signal: DataFrame, start: int, length: int) -> DataFrame:
    """Frames 0 to start+length: zeros before the range, the signal's first frames inside it."""
    grid = signal.select("rec").distinct().crossJoin(spark.range(start + length).select(F.col("id").alias("frame")))
    own = signal.select("rec", (F.col("frame") + start).alias("frame"), "cents")
    return grid.join(own, ["rec", "frame"], "left").select("rec", "frame", F.coalesce("cents", F.lit(0)).cast("long").alias("cents"))
