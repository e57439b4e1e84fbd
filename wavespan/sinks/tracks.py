"""Track files: ranges of WAV and MPEG recordings copied or coded anew, each written beside its place and then moved."""

from __future__ import annotations

import bisect
import itertools
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from wavespan.functions import numbers
from wavespan.functions.numbers import KBPS_1, KBPS_2
from wavespan.sinks.tags import crc16, id3v2
from wavespan.sources import mp3, wav
from wavespan.sources.files import Slice, byte_slice, ship, store, tasks

STEP = 1 << 16


def wav_head(fmt: bytes, length: int) -> bytes:
    chunk = struct.pack("<4sI", b"fmt ", len(fmt)) + fmt + b"\0" * (len(fmt) % 2)
    riff = 4 + len(chunk) + 8 + length + length % 2
    if riff > 0xFFFFFFFF:
        raise ValueError("larger than the 4 GB that WAV holds")
    return struct.pack("<4sI4s", b"RIFF", riff, b"WAVE") + chunk + struct.pack("<4sI", b"data", length)


def _clamped(ranges: list[tuple[int, int]], frames: int) -> list[tuple[int, int]]:
    kept = [(min(a, frames), min(b, frames)) for a, b in ranges]
    kept = [(a, b) for a, b in kept if a < b]
    if not kept:
        raise ValueError("empty track")
    return kept


def wav_copy(row: dict, ranges: list[tuple[int, int]]) -> Iterator[bytes]:
    """The ranges' bytes one after another under a new head, with the source's own format."""
    kept = _clamped(ranges, row["frames"])
    length = sum(b - a for a, b in kept) * row["align"]
    yield wav_head(row["fmt"], length)
    for a, b in kept:
        yield from byte_slice(row["path"], row["data"] + a * row["align"], row["data"] + b * row["align"])
    yield b"\0" * (length % 2)


def pcm16(x: np.ndarray, gain_db: float = 0.0) -> bytes:
    """Half away from zero, then clamped."""
    scaled = x * 10 ** (gain_db / 20) * 32768
    return np.clip(np.sign(scaled) * np.floor(np.abs(scaled) + 0.5), -32768, 32767).astype("<i2").tobytes()


def wav16(row: dict, ranges: list[tuple[int, int]], gain_db: float = 0.0) -> Iterator[bytes]:
    """The ranges decoded, with a gain, as 16-bit samples."""
    kept = _clamped(ranges, row["frames"])
    align = 2 * row["channels"]
    yield wav_head(struct.pack("<HHIIHH", 1, row["channels"], row["rate"], row["rate"] * align, align, 16), sum(b - a for a, b in kept) * align)
    for a, b in kept:
        for _, x in wav._chunks(row | {"first": a, "last": b}, STEP):
            yield pcm16(x, gain_db)


#: What follows the side information in a frame of tables, with its bytes: fixed by the Xing header and its extension.
FIELDS = {"mark": 4, "which": 4, "frames": 4, "bytes": 4, "seek": 100, "quality": 4, "encoder": 9, "method": 1, "lowpass": 1, "peak": 4, "gains": 4, "flags": 1, "rate": 1, "trim": 3, "misc": 1, "volume": 1, "preset": 2, "length": 4, "audio_sum": 2, "own_sum": 2}
ENCODER = b"wavespan1"


def empty_frame(like: bytes, room: int) -> bytearray:
    """Zeros under a header like another's, without checksum and padding: the shortest with so much room after the side information."""
    own = mp3.header(like)
    lengths = [own.samples * 125 * kbps // own.rate for kbps in (KBPS_1 if own.version == 1 else KBPS_2)]
    index = bisect.bisect_left(lengths, 4 + own.side + room)
    if index == len(lengths):
        raise ValueError("no frame is large enough")
    word = (int.from_bytes(like, "big") | 1 << 16) & ~0xF200 | (index + 1) << 12
    return bytearray(word.to_bytes(4, "big").ljust(lengths[index], b"\0"))


def frame_of_tables(like: bytes, vbr: bool, seek: bytes, frames: int, audio_bytes: int, audio_sum: int, trim: tuple[int, int]) -> bytes:
    """The frame before the audio: how much there is, where its hundredths lie, and what to trim at both ends."""
    frame = empty_frame(like, sum(FIELDS.values()))
    whole, ends = len(frame) + audio_bytes, [min(x, numbers.TRIM_MOST) for x in trim]
    values = {"mark": b"Xing" if vbr else b"Info", "which": 15, "frames": frames, "bytes": whole, "seek": seek, "encoder": ENCODER, "trim": ends[0] << 12 | ends[1], "length": whole, "audio_sum": audio_sum}
    at = 4 + mp3.header(like).side
    for name, width in FIELDS.items():
        value = crc16(bytes(frame[:at])) if name == "own_sum" else values.get(name, 0)
        frame[at : at + width] = value if isinstance(value, bytes) else value.to_bytes(width, "big")
        at += width
    return bytes(frame)


def mp3_cuts(jobs: DataFrame, frame_rows: DataFrame) -> DataFrame:
    """Jobs (path, start, stop and more) with ``cut``: the plan and the bytes to read; null for an empty track.

    Jobs meet only their first and last frame, by equi joins; a running total of audio data tells where the 511 bytes
    before a frame begin.
    """
    order = Window.partitionBy("path").orderBy("frame")
    placed = frame_rows.select("path", "frame", "start", "length", F.coalesce(F.sum("main").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long").alias("bytes"))
    far = Window.partitionBy("path").orderBy("bytes").rangeBetween(Window.unboundedPreceding, -mp3.RESERVOIR)
    zero = Window.partitionBy("path").orderBy("frame").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = placed.select("path", "frame", "start", (F.col("start") + F.col("length")).alias("end"), F.coalesce(F.max("start").over(far), F.min("start").over(zero)).alias("reservoir"))
    info = mp3.summary(frame_rows).select("path", F.col("frames").alias("n"), (F.col("total") / F.col("frames")).cast("long").alias("spf"), "vbr")
    planned = jobs.join(info, "path").withColumn("plan", numbers.cut_plan(F.col("start"), F.col("stop"), F.col("spf"), F.col("n")))
    head = placed.select("path", F.col("frame").alias("_first"), F.col("start").alias("_from"), "reservoir")
    tail = placed.select("path", F.col("frame").alias("_last"), F.col("end").alias("_to"))
    keyed = planned.withColumn("_first", F.col("plan.first")).withColumn("_last", F.col("plan.first") + F.col("plan.frames") - 1)
    met = keyed.join(head, ["path", "_first"], "left").join(tail, ["path", "_last"], "left")
    cut = F.when(F.col("plan").isNotNull(), F.struct("plan.*", "vbr", "reservoir", F.col("_from").alias("from"), F.col("_to").alias("to")))
    return met.withColumn("cut", cut).drop("plan", "_first", "_last", "_from", "_to", "reservoir", "n", "spf", "vbr")


def carried(path: str, cut: dict, like: bytes) -> bytes:
    """A silent frame that ends with the audio data that the cut's first frames reach back for."""
    lead = Slice(path, cut["reservoir"], cut["from"])
    data = b"".join(lead.read_at(main, at + h.length - main) for at, h, _, main in mp3.frames(mp3.Blocks(lead)))
    frame = empty_frame(like, mp3.RESERVOIR)
    frame[-mp3.RESERVOIR :] = data[-mp3.RESERVOIR :].rjust(mp3.RESERVOIR, b"\0")
    return bytes(frame)


def mp3_copy(path: str, cut: dict | None, tags: bytes = b"") -> Iterator[bytes]:
    """Tags, the frame of tables, the carrier frame if there is one, and the frames' own bytes.

    The bytes are read twice, a block at a time: once for the tables before them, once to be copied.
    """
    if not cut:
        raise ValueError("empty track")
    part = Slice(path, cut["from"], cut["to"])
    like = part.read_at(4, 0)
    lead = carried(path, cut, like) if cut["carrier"] else b""
    places = np.fromiter((at for at, *_ in mp3.frames(mp3.Blocks(part))), np.int64) + len(lead)
    places = np.concatenate(([0] if lead else [], places)).astype(np.int64)
    checksum = crc16(lead)
    for block in byte_slice(path, cut["from"], cut["to"]):
        checksum = crc16(block, checksum)
    size = len(lead) + part.size()
    head = len(empty_frame(like, sum(FIELDS.values())))
    hundredths = places[np.arange(100) * len(places) // 100]
    seek = np.minimum((head + hundredths) * 256 // (head + size), 255).astype(np.uint8).tobytes()
    yield tags
    yield frame_of_tables(like, cut["vbr"], seek, len(places), size, checksum, (cut["delay"], cut["padding"]))
    yield lead
    yield from byte_slice(path, cut["from"], cut["to"])


def write(target: str, pieces: Iterator[bytes]) -> int:
    """Writes beside the target under a name of its own, then moves: a task that is lost or runs twice leaves one whole file."""
    system, path = store(target)
    part = f"{path}.{uuid.uuid4().hex}.part"
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    try:
        size = 0
        with system.open_output_stream(part) as out:
            for piece in pieces:
                size += out.write(piece)
        system.move(part, path)
    except BaseException:
        if system.get_file_info(part).type != fs.FileType.NotFound:
            system.delete_file(part)
        raise
    return size


def export(jobs: DataFrame) -> DataFrame:
    """(target, bytes, error): writes a file for each job; a job that fails has its error and leaves no part behind.

    Jobs have target, profile (original or wav16), path, ranges (array of start and stop), gain, tags (title, album,
    track, total), and either ``layout`` (of a WAV file) or ``cut`` (of an MPEG file, from ``mp3_cuts``). Read the
    result once: each reading writes the files again, with the same bytes.
    """

    def one(job: dict) -> Iterator[bytes]:
        ranges = [(r["start"], r["stop"]) for r in job["ranges"] or []]
        if job.get("layout"):
            return wav_copy(job["layout"], ranges) if job["profile"] == "original" else wav16(job["layout"], ranges, job.get("gain") or 0.0)
        if job["profile"] == "original" and "cut" in job:
            return mp3_copy(job["path"], job["cut"], id3v2(**(job.get("tags") or {})))
        raise ValueError("can't be copied")

    def run(batches):
        for batch in batches:
            rows = []
            for job in batch.to_pylist():
                try:
                    rows.append((job["target"], write(job["target"], one(job)), None))
                except (OSError, ValueError) as failed:
                    rows.append((job["target"], None, str(failed)))
            targets, sizes, errors = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(targets, pa.string()), pa.array(sizes, pa.int64()), pa.array(errors, pa.string())], names=["target", "bytes", "error"])

    ship(jobs.sparkSession)
    return jobs.repartition(tasks(jobs.sparkSession), "target").mapInArrow(run, "target string, bytes long, error string")


def write_samples(samples: DataFrame, rate: int, channels: int = 1) -> DataFrame:
    """(target, frames): samples (target, frame, channel, value) as 16-bit WAV files, streamed in order by one task for each.

    A target is a group, so the plan itself asks for all its rows in one task. A repartition before a plain map does
    not: it goes where the join deals rows alike, and adaptive execution then reads that join's input piece by piece.
    """
    counted = samples.join(samples.groupBy("target").agg(F.countDistinct("frame").alias("total")), "target")
    dealt = counted.repartition(tasks(samples.sparkSession), "target").sortWithinPartitions("target", "frame", "channel").select("target", "total", "value")
    align = 2 * channels

    def whole(total: int, batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        yield wav_head(struct.pack("<HHIIHH", 1, channels, rate, rate * align, align, 16), total * align)
        left = total * channels
        for batch in batches:
            left -= batch.num_rows
            yield pcm16(batch.column("value").to_numpy())
        if left:
            raise ValueError(f"{left} samples are missing")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches)
        target, total = first.column("target")[0].as_py(), first.column("total")[0].as_py()
        write(target, whole(total, itertools.chain([first], batches)))
        yield pa.RecordBatch.from_arrays([pa.array([target]), pa.array([total], pa.int64())], names=["target", "frames"])

    ship(samples.sparkSession)
    return dealt.groupBy("target").applyInArrow(run, "target string, frames long")
