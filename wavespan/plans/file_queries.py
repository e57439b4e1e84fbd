"""File operators over whole tables: the test signal written as files of the shared folder and read again."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavespan.operators import commands, kweighting, levels
from wavespan.plans.recording import BASE, HOP, WINDOW, Recording
from wavespan.plans.recording_queries import CTE
from wavespan.sinks import tracks
from wavespan.sources import files, wav
from wavespan.sources import texts as documents
from wavespan.streaming import levels as streamed

RATE = 8000
SAMPLE = "CAST(greatest(least(round(cents / 50000e0 * 32768), 32767), -32768) AS BIGINT)"


def _folder(spark: SparkSession, name: str) -> str:
    return f"{files.shared_dir(spark)}/wavespan/{name}-{uuid.uuid4().hex}"


def _written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layouts of a WAV file for each recording of the test signal."""
    folder = _folder(spark, "wav")
    signal = Recording(spark, sf_dir).signal
    samples = signal.select(F.concat(F.lit(f"{folder}/"), "rec", F.lit(".wav")).alias("target"), "frame", F.lit(0).alias("channel"), (F.col("cents") / 50000).alias("value"))
    tracks.write_samples(samples, RATE).write.parquet(f"{folder}-done")
    return wav.layouts(files.recordings(spark, folder))


def _rec() -> Column:
    return F.regexp_extract("path", r"([^/]*)\.wav$", 1).alias("rec")


def s4_wav_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _written(spark, sf_dir).select(_rec(), "channels", "rate", "bits", "data", "frames")


def s3_wav_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wav.samples(_written(spark, sf_dir), 1000).select(_rec(), "frame", F.round(F.col("value") * 32768).cast("long").alias("sample"))


def s13_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = wav.scan(_written(spark, sf_dir), size=900)
    return found.select(_rec(), "kind", "idx", "lo", "hi", F.round("power", 9).alias("power"), "n")


def k9_apply_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept ranges back to back in a new file, read again."""
    layouts, target = _written(spark, sf_dir), _folder(spark, "cut")
    ranges = F.array(*[F.struct(F.lit(a).cast("long").alias("start"), F.lit(b).cast("long").alias("stop")) for a, b in ((10, 60), (100, 105))])
    jobs = layouts.select(F.concat(F.lit(f"{target}/"), _rec(), F.lit(".wav")).alias("target"), F.lit("original").alias("profile"), "path", ranges.alias("ranges"), F.lit(0.0).alias("gain"), F.struct("*").alias("layout"))
    tracks.export(jobs).write.parquet(f"{target}-done")
    return wav.samples(wav.layouts(files.recordings(spark, target))).select(_rec(), "frame", F.round(F.col("value") * 32768).cast("long").alias("sample"))


def a9_weighted_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = kweighting.hop_energy(_written(spark, sf_dir))
    return found.select(_rec(), "hop", F.round("energy", 7).alias("energy"), F.round("peak", 7).alias("peak"))


def _chunks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    """The signal as a stream of files, a file at a time."""
    folder = _folder(spark, "stream")
    Recording(spark, sf_dir).signal.repartition(5).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema("rec string, frame long, cents long").option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")
    return stream, folder


def st1_streamed_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream, folder = _chunks(spark, sf_dir)
    return streamed.run_available(streamed.peaks(stream, BASE), ["rec", "bucket"], folder)


def st2_streamed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream, folder = _chunks(spark, sf_dir)
    return streamed.run_available(streamed.windows(stream, WINDOW), ["rec", "win"], folder).select("rec", "win", "ss", "n")


def _commands(r: Recording, ops: list[tuple]) -> DataFrame:
    listed = F.array(*[F.struct(F.lit(k).alias("seq"), F.lit(op).alias("op"), F.lit(at).cast("long").alias("k"), F.lit(pos).cast("long").alias("pos")) for k, (op, at, pos) in enumerate(ops)])
    return r.ends.select("rec", "total", F.explode(listed).alias("c")).select("rec", "total", "c.*")


def _edited(spark: SparkSession, sf_dir: str, ops: list[tuple]) -> DataFrame:
    r = Recording(spark, sf_dir)
    splits = r.splits.select("rec", "pos", F.when(F.col("confirmed"), "Confirmed").otherwise("Suggested").alias("state"), F.lit("").alias("title"), F.lit(False).alias("dropped"))
    return commands.edited(splits, _commands(r, ops)).select("rec", "pos", "state")


def e2_remove_move(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edited(spark, sf_dir, [("remove", 1, None), ("move", 0, 3)])


def e6_confirm_and_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edited(spark, sf_dir, [("confirm_and_next", 1, 0), ("delete_and_next", 0, 0)])


def e9_add_at_playhead(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edited(spark, sf_dir, [("add", None, 7), ("add", None, 0), ("add", None, 1 << 40)])


def e10_undo_redo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edited(spark, sf_dir, [("remove", 0, None), ("add", None, 7), ("undo", None, None), ("undo", None, None), ("redo", None, None)])


def s18_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A change log of lines made from nations, a release for each."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    lines = n.select(F.lit("log").alias("path"), F.posexplode(F.array(F.concat(F.lit("## [1."), F.col("n_nationkey").cast("string"), F.lit(".0] - 2020-01-01")), F.lit("### Added"), F.concat(F.lit("- "), "n_name"), F.lit("  and more"), F.lit("---"), F.lit("- footer"))).alias("k", "line"), "n_nationkey")
    return documents.changes(lines.select("path", (F.col("n_nationkey") * 10 + F.col("k")).alias("n"), "line")).select("version", "date", "heading", "item")


def st3_sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of four hops that end at each hop, from hops that a stream of chunks has filled."""
    stream, folder = _chunks(spark, sf_dir)
    hops = streamed.run_available(streamed.windows(stream, HOP), ["rec", "win"], folder).withColumnRenamed("win", "hop_idx")
    return levels.blocks(hops, 4)


_WRITTEN = f"SELECT rec, frame, {SAMPLE} AS sample FROM signal"


def weighted_sql() -> str:
    """The two filters sample by sample as a recursion, and true peaks as sums over neighbours with written-out weights."""
    (b0, b1, b2, a1, a2), (c0, c1, c2, d1, d2) = kweighting.stages(RATE)
    out = f"({b0!r} * x + s1)"
    second = f"({c0!r} * {out} + u1)"
    step = f"{b1!r} * x - {a1!r} * {out} + s2, {b2!r} * x - {a2!r} * {out}, {c1!r} * {out} - {d1!r} * {second} + u2, {c2!r} * {out} - {d2!r} * {second}, {second}"
    weights = [(phase, 5 - m, 0.0 if (t := m - 6 + phase / 4) == 0 else math.sin(math.pi * t) / (math.pi * t) * (0.5 + 0.5 * math.cos(math.pi * t / 6))) for phase in (1, 2, 3) for m in range(12)]
    hop = RATE // 10
    return f""", x AS MATERIALIZED (SELECT rec, frame, sample / 32768e0 AS x FROM ({_WRITTEN})),
    y AS (SELECT rec, -1::BIGINT AS frame, 0e0 AS s1, 0e0 AS s2, 0e0 AS u1, 0e0 AS u2, 0e0 AS y FROM ends UNION ALL SELECT rec, frame + 1, {step} FROM (SELECT y.*, x.x FROM y JOIN x ON x.rec = y.rec AND x.frame = y.frame + 1)),
    part AS (SELECT rec, frame // {hop} AS hop, sum(y * y) AS e FROM y WHERE frame >= 0 GROUP BY ALL),
    weight(phase, ahead, w) AS (VALUES {", ".join(f"({p}, {a}, {w!r}::DOUBLE)" for p, a, w in weights)}),
    between_ AS (SELECT a.rec, a.frame, phase, abs(sum(w * b.x)) AS v FROM x a CROSS JOIN weight JOIN x b ON b.rec = a.rec AND b.frame = a.frame + ahead GROUP BY ALL),
    peak AS (SELECT rec, frame // {hop} AS hop, max(v) AS peak FROM (SELECT rec, frame, v FROM between_ UNION ALL SELECT rec, frame, abs(x) FROM x) GROUP BY ALL)
    SELECT rec, hop, round((SELECT sum(b.e) FROM part b WHERE b.rec = a.rec AND b.hop BETWEEN a.hop - 3 AND a.hop) / {4 * hop}, 7) AS energy, round(peak, 7) AS peak FROM part a JOIN peak USING (rec, hop)"""


_SPLITS = "SELECT rec, pos, CASE WHEN confirmed THEN 'Confirmed' ELSE 'Suggested' END AS state, idx FROM splitc"
REGISTRY = {
    f.__name__: (f, sql and CTE + sql)
    for f, sql in (
        (s4_wav_layout, f"SELECT rec, 1 AS channels, {RATE} AS rate, 16 AS bits, 44 AS data, total AS frames FROM ends"),
        (s3_wav_samples, _WRITTEN),
        (s13_scan, f", w AS ({_WRITTEN}) SELECT rec, 'peak' AS kind, frame // 256 AS idx, CAST(trunc(min(sample / 32768e0) * 32767) AS BIGINT) AS lo, CAST(trunc(max(sample / 32768e0) * 32767) AS BIGINT) AS hi, CAST(NULL AS DOUBLE) AS power, CAST(NULL AS BIGINT) AS n FROM w GROUP BY ALL UNION ALL SELECT rec, 'level', frame // 400, NULL, NULL, round(avg((sample / 32768e0) ** 2), 9), count(*) FROM w GROUP BY rec, frame // 400"),
        (k9_apply_cuts, f", w AS ({_WRITTEN}) SELECT rec, CASE WHEN frame < 60 THEN frame - 10 ELSE frame - 50 END AS frame, sample FROM w WHERE frame BETWEEN 10 AND 59 OR frame BETWEEN 100 AND 104"),
        (a9_weighted_blocks, weighted_sql()),
        (st3_sliding_windows, "SELECT rec, hop_idx, CAST(ss AS BIGINT) AS ss, CAST(n AS BIGINT) AS n FROM blocks"),
        (st1_streamed_peaks, f"SELECT rec, frame // {BASE} AS bucket, min(cents) AS lo, max(cents) AS hi FROM signal GROUP BY ALL"),
        (st2_streamed_windows, "SELECT rec, win, ss, n FROM win"),
        (e2_remove_move, f"SELECT rec, CASE WHEN idx = 0 THEN 3 ELSE pos END AS pos, state FROM ({_SPLITS}) WHERE idx <> 1"),
        (e6_confirm_and_next, f"SELECT rec, pos, CASE WHEN idx = 1 THEN 'Confirmed' ELSE state END AS state FROM ({_SPLITS}) WHERE idx <> 0"),
        (e9_add_at_playhead, f"SELECT rec, pos, state FROM ({_SPLITS}) WHERE pos <> 7 UNION ALL SELECT rec, 7, 'Confirmed' FROM ends"),
        (e10_undo_redo, f"SELECT rec, pos, state FROM ({_SPLITS}) WHERE idx <> 0"),
        (s18_changes, ", one AS (SELECT 1) SELECT '1.' || n_nationkey || '.0' AS version, '2020-01-01' AS date, 'Added' AS heading, n_name || ' and more' AS item FROM nation"),
    )
}


def queries() -> dict:
    return {name: f for name, (f, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in REGISTRY.items() if sql}
