"""The chain from signal to export plan at the parameters of the test signal."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wavespan.operators import levels, segments
from wavespan.sources import signal as source

WINDOW, QUIET, LEAST, GAP, BASE, FACTOR, LEVELS, HOP, MARGIN = 4, 4500, 2, 40, 16, 4, 3, 4, 1
#: Cents that are full scale.
FULL = 50_000


class Recording:
    """Each property is a lazy DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.signal = spark, source.events_signal(spark, sf_dir)

    @cached_property
    def ends(self) -> DataFrame:
        return source.totals(self.signal)

    @cached_property
    def windows(self) -> DataFrame:
        return levels.windows(self.signal, WINDOW).withColumn("quiet", F.col("ss") < QUIET * QUIET * F.col("n"))

    @cached_property
    def runs(self) -> DataFrame:
        return segments.runs(self.windows, LEAST)

    @cached_property
    def silences(self) -> DataFrame:
        return segments.tag(self.runs, self.ends, WINDOW, MARGIN).withColumn("keep", F.col("start") % 5 == 0)

    @cached_property
    def suggestions(self) -> DataFrame:
        return segments.suggest(self.runs, self.ends, WINDOW)

    @cached_property
    def splits(self) -> DataFrame:
        rows = segments.thin(self.suggestions, GAP)
        return rows.withColumn("idx", (F.row_number().over(segments.by_pos()) - 1).cast("long")).withColumn("confirmed", F.col("idx") % 3 == 0)

    @cached_property
    def tracks(self) -> DataFrame:
        return segments.tracks(self.splits, self.ends).withColumn("dropped", F.col("idx") % 4 == 3)

    @cached_property
    def audible(self) -> DataFrame:
        own = segments.audible(self.tracks.drop("dropped"), self.silences.filter("NOT keep"))
        return own.withColumn("dropped", F.col("idx") % 4 == 3).withColumn("exported", ~F.col("dropped") & (F.col("audio_stop") > F.col("audio_start")))

    @cached_property
    def skipped(self) -> DataFrame:
        return segments.left_out(self.audible)

    @cached_property
    def kept(self) -> DataFrame:
        return segments.complement(self.skipped, self.ends)

    @cached_property
    def exported(self) -> DataFrame:
        """(rec, idx, start, stop) of the exported tracks' audio."""
        return self.audible.filter("exported").select("rec", "idx", F.col("audio_start").alias("start"), F.col("audio_stop").alias("stop"))

    @cached_property
    def sounding(self) -> tuple[DataFrame, DataFrame]:
        """Blocks (rec, hop_idx, energy) and hops (rec, hop_idx, peak) of full scale 1."""
        return self.blocks.select("rec", "hop_idx", (F.col("ss") / F.col("n") / FULL**2).alias("energy")), self.hops.select("rec", "hop_idx", (F.col("peak") / FULL).alias("peak"))

    @cached_property
    def hops(self) -> DataFrame:
        return levels.hops(self.signal, HOP)

    @cached_property
    def blocks(self) -> DataFrame:
        return levels.blocks(self.hops, 4)

    @cached_property
    def plan(self) -> DataFrame:
        own = self.audible.filter("exported")
        order = Window.partitionBy("rec").orderBy("idx")
        return own.select("rec", "idx", "audio_start", "audio_stop", F.row_number().over(order).cast("long").alias("number"), F.count(F.lit(1)).over(Window.partitionBy("rec")).alias("of"))
