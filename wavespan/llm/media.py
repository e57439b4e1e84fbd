"""Media columns: payloads as WAV, and audio features of them as fixed-shape tensors with time spans.

Spark has no tensor type, so a document's tensors are a binary column: an Arrow record batch, in Arrow's own
serial form, whose column ``tensor`` is of the fixed-shape tensor type beside each tensor's time span. Parquet files
in the shared folder keep both the media and the tensors.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from wavespan.llm.common import arrow_steps, discard, id_and_text, materialize

#: Samples a second as stored, and the ratio at which they are resampled.
RATE, UP, DOWN = 16_000, 3, 4
TAPS = 16
FRAME, HOP, MELS = 256, 128, 20
#: Frames of a tensor; the last is filled up with the floor.
CLIP = 32
FLOOR_DB = -100.0
#: Hysteresis: a span begins over the one and ends under the other, in dB against the recording's mean power.
BEGIN_DB, END_DB = 0.5, -0.5
ALIGN = 64
WINDOW = np.hanning(FRAME).astype(np.float32)


def wav_bytes(payload: bytes, rate: int = RATE) -> bytes:
    """8-bit mono PCM; the payload's bytes are the samples."""
    body = payload + b"\0" * (len(payload) % 2)
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(body), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload)) + body


def wav_payload(media: bytes) -> tuple[bytes, int]:
    """(samples, rate) of 8-bit mono PCM, by its chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, None
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("not 8-bit mono PCM")
        elif name == b"data":
            return media[at + 8 : at + 8 + size], rate
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


@lru_cache
def low_pass(up: int, down: int, taps: int = TAPS) -> np.ndarray:
    """Windowed sinc for the lower of the two rates; 2 * taps * max(up, down) + 1 values that add up to ``up``."""
    wide = max(up, down)
    n = np.arange(-taps * wide, taps * wide + 1)
    h = np.sinc(n / wide) * np.kaiser(len(n), 8.0)
    return (up * h / h.sum()).astype(np.float32)


def resample(x: np.ndarray, up: int = UP, down: int = DOWN) -> np.ndarray:
    """Polyphase: output m takes only the filter's phase (m * down + half) mod up, and no other output is worked out."""
    h = low_pass(up, down)
    half, n = len(h) // 2, -(-len(x) * up // down)
    out, edge = np.zeros(n, np.float32), len(h)
    padded = np.concatenate((np.zeros(edge, np.float32), x, np.zeros(edge + down, np.float32)))
    for first in range(min(up, n)):  # outputs first, first + up, ... have one phase, and inputs ``down`` apart
        phase, last = (first * down + half) % up, (first * down + half) // up
        count = len(range(first, n, up))
        own = out[first::up]
        for k, tap in enumerate(h[phase::up]):
            start = edge + last - k
            own += tap * padded[start : start + (count - 1) * down + 1 : down]
    return out


@lru_cache
def mel_bank(rate: float, frame: int = FRAME, mels: int = MELS) -> np.ndarray:
    """Overlapping triangles, evenly spaced in mel, over the bins of a frame's spectrum."""
    mel = np.linspace(0, 2595 * np.log10(1 + rate / 2 / 700), mels + 2)
    edge = 700 * (10 ** (mel / 2595) - 1)
    bins = np.arange(frame // 2 + 1) * rate / frame
    rise = (bins[None, :] - edge[:-2, None]) / np.diff(edge)[:-1, None]
    fall = (edge[2:, None] - bins[None, :]) / np.diff(edge)[1:, None]
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32).T


def log_mel(x: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """(frames by mels in dB, power in dB of each frame); the last frame is filled up with silence."""
    bank = mel_bank(rate)
    n = max(1, -(-max(len(x) - FRAME, 0) // HOP) + 1)
    padded = np.concatenate((x, np.zeros((n - 1) * HOP + FRAME - len(x), np.float32)))
    view = np.lib.stride_tricks.sliding_window_view(padded, FRAME)[::HOP]
    mels, power = [], []
    for k in range(0, n, 4096):
        frames = view[k : k + 4096]
        spectrum = np.fft.rfft(frames * WINDOW, axis=1)
        mels.append((spectrum.real**2 + spectrum.imag**2) @ bank)
        power.append((frames * frames).mean(axis=1))
    floor = 10 ** (FLOOR_DB / 10)
    return 10 * np.log10(np.maximum(np.concatenate(mels), floor)), 10 * np.log10(np.maximum(np.concatenate(power), floor))


def hysteresis_spans(power: np.ndarray, begin_db: float = BEGIN_DB, end_db: float = END_DB) -> list[tuple[int, int]]:
    """Frames [begin, end) from where the power is over begin_db until it is under end_db, against its mean."""
    level = power - power.mean() if len(power) else power
    event = np.where(level > begin_db, 1, np.where(level < end_db, -1, 0))
    last = np.maximum.accumulate(np.where(event != 0, np.arange(len(event)), -1))
    on = np.concatenate(([False], (last >= 0) & (event[np.maximum(last, 0)] > 0), [False]))
    edges = np.flatnonzero(on[1:] != on[:-1])
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def features(media: bytes) -> dict:
    """Tensors (clips, CLIP, MELS) in dB, the clips' time spans, and spans of energy, in seconds."""
    payload, rate = wav_payload(media)
    x = (np.frombuffer(payload, np.uint8).astype(np.float32) - 128) / 128
    mels, power = log_mel(resample(x), rate * UP / DOWN)
    step = HOP * DOWN / UP / rate
    clips = -(-len(mels) // CLIP)
    tensor = np.full((clips * CLIP, MELS), FLOOR_DB, np.float32)
    tensor[: len(mels)] = mels
    return {
        "tensors": tensor.reshape(clips, CLIP, MELS),
        "clip_spans": [(k * CLIP * step, min((k + 1) * CLIP, len(mels)) * step) for k in range(clips)],
        "energy_spans": [(a * step, b * step) for a, b in hysteresis_spans(power)],
        "payload": payload,
    }


def store_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8, filled up with zero bytes to a positive multiple of 64, as WAV.

    A null or empty text becomes 64 zero bytes with n_bytes 0. Equal texts, also in repeated rows, give equal media; a
    text of any length is one file. An empty table gives an empty result.
    """

    def run(batches):
        for batch in batches:
            texts = batch.column("text")
            for a, b in arrow_steps(texts):
                own = [v.as_buffer().to_pybytes() for v in texts.slice(a, b - a).cast(pa.binary())]
                media = [wav_bytes(x + b"\0" * (max(ALIGN, -(-len(x) // ALIGN) * ALIGN) - len(x))) for x in own]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(list(map(len, own)), pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, n_bytes long, media binary")


#: The rows of a document's tensors.
TENSORS = pa.schema([("begin_s", pa.float64()), ("end_s", pa.float64()), ("tensor", pa.fixed_shape_tensor(pa.float16(), [CLIP, MELS]))])
SPANS = "array<struct<begin_s: double, end_s: double>>"


def tensor_bytes(values: np.ndarray, spans: list[tuple[float, float]]) -> bytes:
    """(clips, CLIP, MELS) values with their time spans as a serial record batch."""
    tensors = pa.FixedShapeTensorArray.from_numpy_ndarray(np.ascontiguousarray(values, np.float16))
    begin, end = zip(*spans, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(begin), pa.array(end), tensors], schema=TENSORS).serialize().to_pybytes()


def read_tensors(data: bytes) -> pa.RecordBatch:
    """The record batch of a document's tensors; ``column("tensor").to_numpy_ndarray()`` has (clips, CLIP, MELS)."""
    return pa.ipc.read_record_batch(data if isinstance(data, pa.Buffer) else pa.py_buffer(data), TENSORS)


FEATURES = f"doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, tensors binary, energy_spans {SPANS}"


def audio_features(media: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, digests of payload and media, tensors, energy_spans) of stored media (doc_id, n_bytes, media).

    ``tensors`` holds log-mel frames in dB, CLIP at a time, for ``read_tensors``; the last clip is filled up with the
    floor, and its span ends with its frames. An empty table gives an empty result.
    """
    span = pa.list_(pa.struct([("begin_s", pa.float64()), ("end_s", pa.float64())]))
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), span)

    def run(batches):
        for batch in batches:
            column = batch.column("media")
            for a, b in arrow_steps(column):
                rows = []
                for media in column.slice(a, b - a):
                    stored = media.as_buffer().to_pybytes()
                    found = features(stored)
                    payload, spans = found["payload"], [{"begin_s": x, "end_s": y} for x, y in found["energy_spans"]]
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ALIGN:]), len(stored), hashlib.sha256(stored).hexdigest(), tensor_bytes(found["tensors"], found["clip_spans"]), spans))
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), batch.column("n_bytes").slice(a, b - a), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "tensors", "energy_spans"])

    return media.mapInArrow(run, FEATURES)


def stored_features(docs: DataFrame) -> DataFrame:
    """``audio_features`` of docs' media. Media are written to the shared folder and read back, and so are the tensors."""
    media = materialize(store_media(docs), "media", compression="zstd")
    out = materialize(audio_features(media), "media-tensors", compression="zstd")
    discard(media)
    return out


def media_digest(docs: DataFrame) -> DataFrame:
    """One row for each document with digests of what was stored and read back.

    ``feature`` has the number of clips, of energy spans and their seconds, and the SHA-256 of the stored tensors'
    values and spans. Equal texts give equal rows but for doc_id.
    """

    def run(batches):
        for batch in batches:
            said = []
            for data, spans in zip(batch.column("tensors"), batch.column("energy_spans").to_pylist(), strict=True):
                rows = read_tensors(data.as_buffer())
                values = hashlib.sha256(rows.column("tensor").to_numpy_ndarray().tobytes())
                values.update(np.array([rows.column(0).to_numpy(), rows.column(1).to_numpy()]).tobytes())
                said.append(f"clips={rows.num_rows};spans={len(spans)};seconds={sum(x['end_s'] - x['begin_s'] for x in spans):.3f};tensors={values.hexdigest()}")
            names = [n for n in batch.schema.names if n not in ("tensors", "energy_spans")]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(said, pa.string())], names=[*names, "feature"])

    return stored_features(docs).mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
