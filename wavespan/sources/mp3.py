"""MPEG Layer III files: an index row for each audio frame, and where a decoder has to start for each."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavespan.functions.numbers import AHEAD, KBPS_1, KBPS_2, RATES
from wavespan.sources.files import ship, store, tasks

INDEX = "path string, frame long, start long, length int, kbps int, rate int, samples int, channels int, back int, main int"
BLOCK, BATCH = 1 << 20, 50_000
#: Bytes that a frame's audio data may lie before the frame.
RESERVOIR = 511


class Header(NamedTuple):
    version: int
    rate: int
    kbps: int
    channels: int
    length: int
    samples: int
    side: int
    crc: int


def header(b: bytes) -> Header | None:
    """Of the first four bytes; None for another layer, free format and reserved values."""
    if len(b) < 4 or b[0] != 0xFF or b[1] & 0xE6 != 0xE2:
        return None
    version, kbps, rate = {0: 25, 2: 2, 3: 1}.get(b[1] >> 3 & 3), b[2] >> 4, b[2] >> 2 & 3
    if version is None or kbps in (0, 15) or rate == 3:
        return None
    mono, one = b[3] >> 6 == 3, version == 1
    kbps, rate = (KBPS_1 if one else KBPS_2)[kbps - 1], RATES[rate] // {1: 1, 2: 2, 25: 4}[version]
    samples = 1152 if one else 576
    side = {(True, False): 32, (True, True): 17, (False, False): 17, (False, True): 9}[one, mono]
    return Header(version, rate, kbps, 1 if mono else 2, samples // 8 * kbps * 1000 // rate + (b[2] >> 1 & 1), samples, side, 2 * (1 - b[1] % 2))


class Blocks:
    """Reads of a file at places that mostly ascend, a block held at a time."""

    def __init__(self, file):
        self.file, self.size, self.start, self.block = file, file.size(), 0, b""

    def at(self, place: int, count: int) -> bytes:
        if place < self.start or place + count > self.start + len(self.block):
            self.start, self.block = place, self.file.read_at(max(min(BLOCK, self.size - place), 0), place) if place < self.size else b""
        return self.block[place - self.start : place - self.start + count]


def frames(read: Blocks) -> Iterator[tuple[int, Header, int, int]]:
    """(place, header, bytes back that its audio data begin, bytes of audio data) of each audio frame.

    All have the first one's version and rate. A frame counts if a like one, a tag or the end follows; frames that
    hold only an encoder's table, and a last frame that is cut, are left out.
    """
    lead = read.at(0, 10)
    at = 0
    if lead[:3] == b"ID3" and len(lead) == 10:
        at = 10 + sum((x & 0x7F) << 7 * k for k, x in enumerate(reversed(lead[6:10]))) + (10 if lead[5] & 0x10 else 0)
    kind = None
    while at + 4 <= read.size:
        h = header(read.at(at, 4))
        if h is None or kind not in (None, h[:2]):
            held = read.at(at, min(4096, read.size - at))
            more = re.compile(b"\xff").search(held, 1)
            at += more.start() if more else len(held)
            continue
        follows = at + h.length
        if follows > read.size:
            return
        after = header(read.at(follows, 4))
        tagged = read.at(follows, 3) == b"TAG" or read.at(follows, 8) == b"APETAGEX"
        if not (follows + 4 > read.size or tagged or (after and after[:2] == h[:2])):
            at += 1
            continue
        kind = h[:2]
        body = read.at(at, min(h.length, 64))
        tag = 4 + h.side
        if not (body[tag : tag + 4] in (b"Xing", b"Info") and not any(body[4:tag])) and body[36:40] != b"VBRI":
            s = body[4 + h.crc : 6 + h.crc]
            back = (s[0] << 1 | s[1] >> 7) if h.version == 1 else s[0]
            yield at, h, back, max(h.length - 4 - h.crc - h.side, 0)
        at = follows


def index(files: DataFrame) -> DataFrame:
    """A row for each audio frame of each path; a file without any has no row. Memory: one block and one batch."""
    names = [c.split()[0] for c in INDEX.split(", ")]
    schema = pa.schema([("path", pa.string()), ("frame", pa.int64()), ("start", pa.int64()), *[(n, pa.int32()) for n in names[3:]]])

    def run(batches):
        for batch in batches:
            for uri in batch.column("path").to_pylist():
                system, path = store(uri)
                rows = []
                with system.open_input_file(path) as f:
                    for k, (at, h, back, main) in enumerate(frames(Blocks(f))):
                        rows.append((uri, k, at, h.length, h.kbps, h.rate, h.samples, h.channels, back, main))
                        if len(rows) == BATCH:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    ship(files.sparkSession)
    return files.select("path").repartition(tasks(files.sparkSession), "path").mapInArrow(run, INDEX)


def summary(frame_rows: DataFrame) -> DataFrame:
    """(path, frames, total, rate, channels, least, most, mean, vbr, audio_end); the mean is an integer division."""
    n = F.count(F.lit(1))
    return frame_rows.groupBy("path").agg(n.alias("frames"), F.sum("samples").alias("total"), F.first("rate").alias("rate"), F.min_by("channels", "frame").alias("channels"), F.min("kbps").alias("least"), F.max("kbps").alias("most"), F.floor(F.sum("kbps") / n).cast("long").alias("mean"), (F.min("kbps") != F.max("kbps")).alias("vbr"), F.max(F.col("start") + F.col("length")).alias("audio_end"))


def packet_kbps(frame_rows: DataFrame) -> DataFrame:
    """(path, kbps): bytes of all packets over the time they last, rounded; null where that is 0."""
    secs = F.sum(F.col("samples") / F.col("rate"))
    kbps = F.round(F.sum("length") * 8 / 1000.0 / secs).cast("long")
    return frame_rows.groupBy("path").agg(F.when(kbps > 0, kbps).alias("kbps"))


def decode_starts(frame_rows: DataFrame) -> DataFrame:
    """(path, frame, decode_from): the earliest frame that a decoder needs to give a frame as a full decode does.

    A frame needs the two before it, and each of the three the audio data up to ``back`` bytes before itself. With
    running totals of audio data, the frame in which those begin is an as-of lookup: frames and lookups are sorted
    together by (path, bytes), and each lookup takes the last frame before it.
    """
    order = Window.partitionBy("path").orderBy("frame")
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    placed = frame_rows.select("path", "frame", "back", F.coalesce(F.sum("main").over(upto), F.lit(0)).alias("bytes"))
    both = placed.select("path", "bytes", F.lit(0).alias("ask"), "frame").unionByName(placed.select("path", (F.col("bytes") - F.col("back")).alias("bytes"), F.lit(1).alias("ask"), "frame"))
    before = Window.partitionBy("path").orderBy("bytes", "ask", "frame").rowsBetween(Window.unboundedPreceding, 0)
    asked = both.withColumn("found", F.last(F.when(F.col("ask") == 0, F.col("frame")), ignorenulls=True).over(before)).filter("ask = 1")
    own = asked.select("path", "frame", F.least(F.coalesce("found", F.lit(0)), "frame").alias("begins"))
    three = F.min("begins").over(order.rowsBetween(-AHEAD, 0))
    return own.select("path", "frame", F.least(three, F.greatest(F.col("frame") - AHEAD, F.lit(0))).alias("decode_from"))
