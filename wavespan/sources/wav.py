"""WAV files: layouts, samples by ranges of frames, and the scan of peaks and levels.

A range of frames is a task's work, so one long recording is read by many tasks and none holds it whole.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavespan.sources.files import ship, store, tasks

LAYOUT = "path string, format int, channels int, rate int, bits int, align int, fmt binary, data long, frames long, error string"
#: Frames of a task's range: a multiple of what buckets and windows of the usual rates divide.
RANGE = 1 << 22


def layout(uri: str) -> dict:
    """Where a RIFF file's samples lie; ``error`` says why there are none."""
    system, path = store(uri)
    with system.open_input_file(path) as f:
        size, fmt, at = f.size(), None, 12
        head = f.read_at(min(12, size), 0)
        if head[:4] != b"RIFF" or head[8:12] != b"WAVE":
            return {"path": uri, "error": "not a RIFF/WAVE file"}
        while at + 8 <= size:
            kind, length = struct.unpack("<4sI", f.read_at(8, at))
            if kind == b"fmt ":
                fmt = f.read_at(length, at + 8)
            elif kind == b"data":
                if fmt is None or len(fmt) < 16:
                    return {"path": uri, "error": "data before fmt"}
                form, channels, rate, _, align, bits = struct.unpack("<HHIIHH", fmt[:16])
                if form == 0xFFFE and len(fmt) >= 26:
                    form = struct.unpack_from("<H", fmt, 24)[0]
                if align == 0 or channels == 0:
                    return {"path": uri, "error": "no block alignment"}
                return {"path": uri, "format": form, "channels": channels, "rate": rate, "bits": bits, "align": align, "fmt": fmt, "data": at + 8, "frames": min(length, size - at - 8) // align, "error": None}
            at += 8 + length + length % 2
    return {"path": uri, "error": "no data"}


def layouts(files: DataFrame) -> DataFrame:
    """Layout of each path, one small read for each chunk header."""
    names = [c.split()[0] for c in LAYOUT.split(", ")]

    def run(batches):
        schema = pa.schema([("path", pa.string()), *[(n, pa.int32()) for n in names[1:6]], ("fmt", pa.binary()), ("data", pa.int64()), ("frames", pa.int64()), ("error", pa.string())])
        for batch in batches:
            yield pa.RecordBatch.from_pylist([layout(p) for p in batch.column("path").to_pylist()], schema=schema)

    ship(files.sparkSession)
    return files.select("path").mapInArrow(run, LAYOUT)


def decode(data: bytes, form: int, bits: int, channels: int, align: int) -> np.ndarray:
    """(frames, channels) of numbers in -1 to 1."""
    width = align // channels
    if form != 3 and width in (2, 4):
        own = np.frombuffer(data, f"<i{width}", len(data) // align * channels).reshape(-1, channels)
        return own * (0.5 ** (8 * width - 1))
    raw = np.frombuffer(data[: len(data) // align * align], np.uint8).reshape(-1, channels, width)
    if form == 3:
        return raw.reshape(-1).view("<f8" if width == 8 else "<f4").reshape(-1, channels).astype(np.float64)
    if width == 1:
        return (raw[:, :, 0].astype(np.float64) - 128) / 128
    wide = np.zeros((*raw.shape[:2], 8), np.uint8)
    wide[:, :, 8 - width :] = raw
    return wide.reshape(-1).view("<i8").reshape(-1, channels) / 2.0**63


def ranges(layout_rows: DataFrame, size: int = RANGE, start: int = 0) -> DataFrame:
    """A row for each range of at most ``size`` frames, dealt evenly over the tasks."""
    good = layout_rows.filter(F.col("error").isNull() & (F.col("frames") > start))
    each = good.withColumn("first", F.explode(F.sequence(F.lit(start).cast("long"), F.col("frames") - 1, F.lit(size).cast("long"))))
    return each.withColumn("last", F.least("frames", F.col("first") + size)).repartition(tasks(layout_rows.sparkSession), "path", "first")


def _chunks(row: dict, frames: int = 1 << 16):
    system, path = store(row["path"])
    with system.open_input_file(path) as f:
        for a in range(row["first"], row["last"], frames):
            b = min(row["last"], a + frames)
            yield a, decode(f.read_at((b - a) * row["align"], row["data"] + a * row["align"]), row["format"], row["bits"], row["channels"], row["align"])


def samples(layout_rows: DataFrame, size: int = RANGE, start: int = 0, stop: int | None = None) -> DataFrame:
    """(path, frame, channel, value): the PCM of every file, or of its frames from ``start`` to ``stop``, read by ranges.

    No other frames are read.
    """
    own = layout_rows.withColumn("frames", F.least("frames", F.lit(stop))) if stop is not None else layout_rows

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                for a, x in _chunks(row):
                    n, channels = x.shape
                    yield pa.RecordBatch.from_arrays([pa.array([row["path"]]).dictionary_encode().take(pa.array(np.zeros(n * channels, np.int32))).cast(pa.string()), pa.array(np.repeat(np.arange(a, a + n), channels)), pa.array(np.tile(np.arange(channels, dtype=np.int32), n)), pa.array(x.reshape(-1))], names=["path", "frame", "channel", "value"])

    ship(layout_rows.sparkSession)
    return ranges(own, size, start).mapInArrow(run, "path string, frame long, channel int, value double")


def _folded(x: np.ndarray, first: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the buckets that frames from ``first`` on fall into, and where each begins."""
    number = np.arange(first // width, (first + len(x) - 1) // width + 1)
    return number, np.maximum(number * width - first, 0)


def scan(layout_rows: DataFrame, bucket: int = 256, window_ms: int = 50, size: int = RANGE) -> DataFrame:
    """(path, kind, idx, lo, hi, power, n): ``peak`` buckets over all channels, and ``level`` windows' mean power.

    Tasks fold their ranges before the shuffle, which then carries a row for each bucket and window, and joins those
    that two ranges share. Peaks are whole numbers cut towards zero; the last bucket and window may be partial.
    """

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                window = max(row["rate"] * window_ms // 1000, 1)
                for a, x in _chunks(row):
                    own = x.T.copy()  # channels one after another
                    low, high, power = own[0], own[0], own[0] * own[0]
                    for c in own[1:]:
                        low, high, power = np.minimum(low, c), np.maximum(high, c), power + c * c
                    number, at = _folded(x, a, bucket)
                    whole = lambda v: np.trunc(np.clip(v, -1, 1) * 32767)
                    yield _rows(row["path"], "peak", number, lo=whole(np.minimum.reduceat(low, at)), hi=whole(np.maximum.reduceat(high, at)))
                    number, at = _folded(x, a, window)
                    yield _rows(row["path"], "level", number, power=np.add.reduceat(power, at) / len(own), n=np.diff(np.append(at, len(x))))

    def _rows(path, kind, number, lo=None, hi=None, power=None, n=None):
        k, none = len(number), lambda t: pa.nulls(len(number), t)
        arrays = [pa.array([path] * k), pa.array([kind] * k), pa.array(number.astype(np.int64))]
        arrays += [none(pa.int32()) if v is None else pa.array(v.astype(np.int32)) for v in (lo, hi)]
        arrays += [none(pa.float64()) if power is None else pa.array(power), none(pa.int64()) if n is None else pa.array(n.astype(np.int64))]
        return pa.RecordBatch.from_arrays(arrays, names=["path", "kind", "idx", "lo", "hi", "power", "n"])

    ship(layout_rows.sparkSession)
    parts = ranges(layout_rows, size).mapInArrow(run, "path string, kind string, idx long, lo int, hi int, power double, n long")
    return parts.groupBy("path", "kind", "idx").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), (F.sum("power") / F.sum("n")).alias("power"), F.sum("n").alias("n"))
