"""Tags as bytes: ID3v2.3, Vorbis comments, and the checksum of encoder tables."""

from __future__ import annotations

import struct
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from wavespan.sources.files import ship


@cache
def _table() -> list[int]:
    """CRC-16/ARC (polynomial 0xA001 reflected) of each byte."""
    value = np.arange(256)
    for _ in range(8):
        value = np.where(value & 1, value >> 1 ^ 0xA001, value >> 1)
    return value.tolist()


def crc16(data: bytes, crc: int = 0) -> int:
    table = _table()
    for b in data:
        crc = crc >> 8 ^ table[(crc ^ b) & 0xFF]
    return crc


def id3v2(title: str = "", album: str = "", track: int = 0, total: int = 0, gains: dict[str, str] | None = None) -> bytes:
    """Empty texts and a track of 0 are left out; texts are UTF-16 with a byte order mark, gains Latin-1."""
    texts = {"TIT2": title, "TALB": album, "TRCK": f"{track}/{total}" if track > 0 else ""}
    bodies = [(k, b"\x01\xff\xfe" + v.encode("utf-16-le")) for k, v in texts.items() if v]
    bodies += [("TXXX", b"\0" + k.encode("latin-1") + b"\0" + v.encode("latin-1")) for k, v in (gains or {}).items()]
    frames = b"".join(struct.pack(">4sIH", k.encode(), len(b), 0) + b for k, b in bodies)
    return b"ID3\x03\0\0" + bytes(len(frames) >> shift & 0x7F for shift in (21, 14, 7, 0)) + frames


def vorbis_comment(title: str = "", album: str = "", track: int = 0, total: int = 0, gains: dict[str, str] | None = None, vendor: str = "wavespan") -> bytes:
    fields = {"TITLE": title, "ALBUM": album, "TRACKNUMBER": str(track or ""), "TRACKTOTAL": str(total) if track else ""} | (gains or {})
    texts = [vendor.encode(), *[f"{k}={v}".encode() for k, v in fields.items() if v]]
    sized = [struct.pack("<I", len(t)) + t for t in texts]
    return sized[0] + struct.pack("<I", len(sized) - 1) + b"".join(sized[1:])


def blocks(rows: DataFrame) -> DataFrame:
    """(key, id3, vorbis, checksum) of rows (key, title, album, track, total): their tags as bytes, and CRC-16 of the title."""

    def run(batches):
        for batch in batches:
            own = [{k: v if v is not None else ("" if k in ("title", "album") else 0) for k, v in r.items()} for r in batch.to_pylist()]
            fields = [{k: r[k] for k in ("title", "album", "track", "total")} for r in own]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([id3v2(**f) for f in fields], pa.binary()), pa.array([vorbis_comment(**f) for f in fields], pa.binary()), pa.array([crc16(f["title"].encode()) for f in fields], pa.int64())], names=["key", "id3", "vorbis", "checksum"])

    ship(rows.sparkSession)
    return rows.selectExpr("cast(key as bigint) key", "title", "album", "cast(track as int) track", "cast(total as int) total").mapInArrow(run, "key long, id3 binary, vorbis binary, checksum long")
