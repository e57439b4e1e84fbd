"""MP4 files: the length of a silent video and the priming of a sound track, from their movie boxes alone."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from wavespan.sources.files import ship, store


def boxes(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(type, body) of the boxes in a body; ends at the first that doesn't fit."""
    at = 0
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1 and at + 16 <= len(data):
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        size = size or len(data) - at
        if size < head or at + size > len(data):
            return
        yield kind, data[at + head : at + size]
        at += size


def within(data: bytes | None, *kinds: bytes) -> bytes | None:
    """Body of the first box of a type in the first box of another type and so on."""
    for kind in kinds:
        data = next((b for k, b in boxes(data or b"") if k == kind), None)
    return data


def movie(uri: str) -> bytes | None:
    """The moov box's body; the media data are skipped, not read."""
    system, path = store(uri)
    with system.open_input_file(path) as f:
        at, end = 0, f.size()
        while at + 8 <= end:
            size, kind = struct.unpack(">I4s", f.read_at(8, at))
            head = 8
            if size == 1 and at + 16 <= end:
                size, head = struct.unpack(">Q", f.read_at(8, at + 8))[0], 16
            size = size or end - at
            if size < head or at + size > end:
                return None
            if kind == b"moov":
                return f.read_at(size - head, at + head)
            at += size
    return None


def _number(form: str, data: bytes, at: int) -> int | None:
    return struct.unpack_from(form, data, at)[0] if len(data) >= at + struct.calcsize(form) else None


def silent_seconds(moov: bytes) -> float | None:
    """Length of a video without a sound track."""
    handlers = {(within(b, b"mdia", b"hdlr") or b"")[8:12] for k, b in boxes(moov) if k == b"trak"}
    head = within(moov, b"mvhd")
    if b"vide" not in handlers or b"soun" in handlers or not head:
        return None
    scale, length = (_number(">I", head, 12), _number(">I", head, 16)) if head[0] == 0 else (_number(">I", head, 20), _number(">Q", head, 24))
    return length / scale if scale and length else None


def priming_seconds(moov: bytes) -> float | None:
    """Where the first edit that isn't empty begins in the first sound track that has one."""
    for kind, track in boxes(moov):
        media, edits = within(track, b"mdia", b"mdhd"), within(track, b"edts", b"elst")
        if kind != b"trak" or (within(track, b"mdia", b"hdlr") or b"")[8:12] != b"soun" or not media or not edits:
            continue
        scale, wide = _number(">I", media, 12 if media[0] == 0 else 20), edits[0] == 1
        for k in range(_number(">I", edits, 4) or 0):
            begin = _number(">q", edits, 16 + 20 * k) if wide else _number(">i", edits, 12 + 12 * k)
            if begin is None:
                break
            if begin >= 0 and scale:
                return begin / scale
    return None


def movies(files: DataFrame) -> DataFrame:
    """(path, silent_seconds, priming_seconds); null where they don't apply or the file isn't one."""

    def run(batches):
        for batch in batches:
            paths = batch.column("path").to_pylist()
            found = [movie(p) for p in paths]
            columns = [[f(m) if m else None for m in found] for f in (silent_seconds, priming_seconds)]
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), *[pa.array(c, pa.float64()) for c in columns]], names=["path", "silent_seconds", "priming_seconds"])

    ship(files.sparkSession)
    return files.select("path").mapInArrow(run, "path string, silent_seconds double, priming_seconds double")
