"""Windowed levels, pyramids of minima and maxima, and loudness over ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavespan.operators.segments import inside


def _div(a, b):
    return F.floor(a / b).cast("long")


def peak_pyramid(signal: DataFrame, base: int, factor: int, levels: int) -> DataFrame:
    """(rec, level, bucket, lo, hi): level 0 from the frames, the others all from level 0's few rows."""
    zero = signal.groupBy("rec", _div(F.col("frame"), base).alias("b")).agg(F.min("cents").alias("lo"), F.max("cents").alias("hi"))
    each = zero.withColumn("level", F.explode(F.array(*[F.lit(k) for k in range(levels)])))
    return each.groupBy("rec", "level", _div(F.col("b"), F.pow(F.lit(factor), F.col("level"))).alias("bucket")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def windows(signal: DataFrame, window: int) -> DataFrame:
    """(rec, win, ss, n): exact sums of squares; the last window may be partial."""
    return signal.groupBy("rec", _div(F.col("frame"), window).alias("win")).agg(F.sum(F.col("cents") * F.col("cents")).alias("ss"), F.count(F.lit(1)).alias("n"))


def decibels(power):
    return 20 * F.log10(F.greatest(F.sqrt(power), F.lit(1e-9)))


def columns(signal: DataFrame, start: int, stop: int, n: int, base: int) -> DataFrame:
    """n columns of a view: minimum and maximum over the buckets that each touches, zeros beyond the data."""
    spark, per = signal.sparkSession, (stop - start) / n
    grid = spark.range(n).select(F.col("id").alias("col"), F.floor((start + F.col("id") * per) / base).cast("long").alias("b0"), F.ceil((start + (F.col("id") + 1) * per) / base).cast("long").alias("b1"))
    grid = grid.select("col", F.explode(F.sequence("b0", F.greatest("b1", F.col("b0") + 1) - 1)).alias("bucket"))
    level = peak_pyramid(signal, base, 4, 1)
    recs = signal.select("rec").distinct()
    return recs.crossJoin(F.broadcast(grid)).join(level, ["rec", "bucket"], "left").groupBy("rec", "col").agg(F.coalesce(F.min("lo"), F.lit(0)).alias("lo"), F.coalesce(F.max("hi"), F.lit(0)).alias("hi"))


def hops(signal: DataFrame, hop: int) -> DataFrame:
    """(rec, hop_idx, ss, n, peak)."""
    return signal.groupBy("rec", _div(F.col("frame"), hop).alias("hop_idx")).agg(F.sum(F.col("cents") * F.col("cents")).alias("ss"), F.count(F.lit(1)).alias("n"), F.max(F.abs("cents")).alias("peak"))


def blocks(hop_rows: DataFrame, width: int) -> DataFrame:
    """(rec, hop_idx, ss, n): a block of ``width`` hops ends at each hop that has as many before it."""
    last = Window.partitionBy("rec").orderBy("hop_idx").rowsBetween(1 - width, 0)
    return hop_rows.select("rec", "hop_idx", F.sum("ss").over(last).alias("ss"), F.sum("n").over(last).alias("n")).filter(F.col("hop_idx") >= width - 1)


#: Hops to a cell of a join with ranges.
CELL = 1 << 10


def blocks_in(block_rows: DataFrame, ranges: DataFrame, hop: int) -> DataFrame:
    """Blocks that lie entirely inside each range (rec, idx, start, stop)."""
    own = ranges.withColumn("lo", F.ceil(F.col("start") / hop) + 3).withColumn("hi", F.floor(F.col("stop") / hop))
    return inside(block_rows, "hop_idx", own, cell=CELL).drop("lo", "hi")


def range_peak(hop_rows: DataFrame, ranges: DataFrame, hop: int) -> DataFrame:
    """(rec, idx, peak) of the hops that each range touches."""
    own = ranges.withColumn("lo", F.floor(F.col("start") / hop)).withColumn("hi", F.ceil(F.col("stop") / hop))
    return inside(hop_rows, "hop_idx", own, cell=CELL).groupBy("rec", "idx").agg(F.max("peak").alias("peak"))


def gated_mean(energies: DataFrame, keys: list[str], absolute: float, relative: float) -> DataFrame:
    """Mean of ``energy`` over two strict gates, the second ``relative`` of the first's mean; NULL if none passes.

    The first mean is folded to a row for each key before it meets the energies again.
    """
    loud = energies.filter(F.col("energy") > absolute)
    gate = energies.groupBy(*keys).agg(F.greatest(F.avg(F.when(F.col("energy") > absolute, F.col("energy"))) * relative, F.lit(absolute)).alias("gate"))
    mean = loud.join(gate, keys).filter("energy > gate").groupBy(*keys).agg(F.avg("energy").alias("mean"))
    return gate.select(*keys).join(mean, keys, "left")


#: Fixed values of BS.1770 and EBU R 128: the offset of loudness, the absolute gate as energy, the relative gate as a share.
OFFSET, ABSOLUTE, RELATIVE = -0.691, 10 ** ((-70 + 0.691) / 10), 0.1
#: ReplayGain's reference level, and the peak that normalising doesn't exceed, in dB.
REFERENCE, CEILING = -18.0, -1.0


def lufs(energy):
    return OFFSET + 10 * F.log10(energy)


def loudness(block_rows: DataFrame, hop_rows: DataFrame, ranges: DataFrame, hop: int, keys: list[str]) -> DataFrame:
    """(keys, lufs, peak_db) of ranges (rec, idx, start, stop), or of those that share the keys taken together.

    Energies and peaks are of full scale 1. ``lufs`` is NULL where no block passes the gates.
    """
    mean = gated_mean(blocks_in(block_rows, ranges, hop), keys, ABSOLUTE, RELATIVE)
    peak = range_peak(hop_rows, ranges, hop).groupBy(*keys).agg(F.max("peak").alias("peak"))
    every = ranges.select(*keys).distinct().join(mean, keys, "left").join(peak, keys, "left")
    return every.select(*keys, lufs(F.col("mean")).alias("lufs"), (20 * F.log10(F.greatest(F.coalesce("peak", F.lit(0.0)), F.lit(1e-10)))).alias("peak_db"))


def normalising_gain(lufs, peak_db, target: float):
    """The gain in dB that brings a loudness to the target, but no peak over the ceiling; 0 for silence."""
    return F.when(lufs.isNull(), 0.0).otherwise(F.least(F.lit(target) - lufs, F.lit(CEILING) - peak_db))


def job_gains(tracks: DataFrame, albums: DataFrame, mode, target: float, coded_anew: bool = True) -> DataFrame:
    """(mode, rec, idx, gain_db, track_gain, track_peak, album_gain, album_peak): a job's gain and its ReplayGain fields.

    ``mode`` is off, track or album, for all jobs or a column of them; bytes that are copied have no gain. The fields
    describe the audio as written, after the gain. A silent track has none, and with a gain for each track there is
    no common album level.
    """
    mode = F.lit(mode) if isinstance(mode, str) else mode
    both = tracks.join(albums.select("rec", F.col("lufs").alias("album_lufs"), F.col("peak_db").alias("album_db")), "rec")
    own, common_gain = normalising_gain(F.col("lufs"), F.col("peak_db"), target), normalising_gain(F.col("album_lufs"), F.col("album_db"), target)
    gain = F.when(mode == "track", own).when(mode == "album", common_gain).otherwise(0.0) if coded_anew else F.lit(0.0)
    known = F.col("lufs").isNotNull()
    common = known & F.col("album_lufs").isNotNull() & (mode != "track")
    amplitude = lambda db: F.pow(F.lit(10.0), (db + F.col("gain_db")) / 20)
    return both.withColumn("mode", mode).withColumn("gain_db", gain).select(
        "mode",
        "rec",
        "idx",
        "gain_db",
        F.when(known, REFERENCE - (F.col("lufs") + F.col("gain_db"))).alias("track_gain"),
        F.when(known, amplitude(F.col("peak_db"))).alias("track_peak"),
        F.when(common, REFERENCE - (F.col("album_lufs") + F.col("gain_db"))).alias("album_gain"),
        F.when(common, amplitude(F.col("album_db"))).alias("album_peak"),
    )
