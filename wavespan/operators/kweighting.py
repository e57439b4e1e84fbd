"""K-weighted energy of 400 ms blocks and true peaks for each 100 ms, by ranges of frames.

The weighting filter is recursive, but what it answers to one sample fades below rounding within a second. So each
range is convolved with that answer over a second of lead-in, and ranges of one recording run in parallel.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavespan.sources import wav
from wavespan.sources.files import ship

SCHEMA = "path string, hop long, weighted double, frames long, peak double"


@cache
def stages(rate: int) -> tuple[tuple[float, ...], ...]:
    """(b0, b1, b2, a1, a2) of ITU-R BS.1770's two filters, a shelf and then a high pass."""
    out = []
    # Fixed values of BS.1770 as analog parameters: centre, gain in dB and quality of the shelf; centre and quality of the high pass.
    for centre, gain, quality in ((1681.974450955533, 3.999843853973347, 0.7071752369554196), (38.13547087602444, None, 0.5003270373238773)):
        k = np.tan(np.pi * centre / rate)
        below = 1 + k / quality + k * k
        if gain is None:
            b = (1.0, -2.0, 1.0)
        else:
            high = 10 ** (gain / 20)
            band = high**0.4996667741545416
            b = tuple(float(v / below) for v in (high + band * k / quality + k * k, 2 * (k * k - high), high - band * k / quality + k * k))
        out.append((*b, float(2 * (k * k - 1) / below), float((1 - k / quality + k * k) / below)))
    return tuple(out)


@cache
def impulse(rate: int) -> np.ndarray:
    """The answer of both filters to one sample, over a second."""
    x = np.zeros(rate)
    x[0] = 1
    for b0, b1, b2, a1, a2 in stages(rate):
        y, s1, s2 = np.zeros(rate), 0.0, 0.0
        for n, v in enumerate(x.tolist()):
            out = b0 * v + s1
            s1, s2 = b1 * v - a1 * out + s2, b2 * v - a2 * out
            y[n] = out
        x = y
    return x


def filtered(x: np.ndarray, answer: np.ndarray) -> np.ndarray:
    """Convolution along frames, as long as the input."""
    n = 1 << int(np.ceil(np.log2(len(x) + len(answer))))
    own = np.ascontiguousarray(x.T)
    return np.fft.irfft(np.fft.rfft(own, n) * np.fft.rfft(answer, n), n)[:, : len(x)].T


@cache
def _between(factor: int) -> np.ndarray:
    """Windowed sinc filters for the places between samples, 12 samples wide."""
    t = np.arange(-6, 6)[None, :] + np.arange(1, factor)[:, None] / factor
    return np.sinc(t) * (0.5 + 0.5 * np.cos(np.pi * t / 6))


def true_peak(x: np.ndarray, rate: int) -> np.ndarray:
    """For each frame the largest amplitude of any channel at it and between it and the next."""
    factor, n = 4 if rate < 96_000 else 2 if rate < 192_000 else 1, len(x)
    peak = np.zeros(n)
    for channel in x.T:
        own = np.pad(channel, 6)
        np.maximum(peak, np.abs(channel), out=peak)
        for f in _between(factor) if factor > 1 else ():
            np.maximum(peak, np.abs(np.convolve(own, f, "full")[11 : 11 + n]), out=peak)
    return peak


def weights(channels: int) -> np.ndarray:
    """1 for the front, 1.41 for the back, 0 for the low channel of five or more with one."""
    own = {4: [1, 1, 1.41, 1.41], 5: [1, 1, 1, 1.41, 1.41]}.get(channels, [1, 1, 1, 0, 1.41, 1.41])
    return np.array((own + [0] * channels)[:channels], float)


def hop_energy(layout_rows: DataFrame, size: int = wav.RANGE) -> DataFrame:
    """(path, hop, energy, peak): mean weighted square over the 400 ms that end with the hop, as if silence came before."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                rate, hop = row["rate"], max(row["rate"] // 10, 1)
                step = 20 * rate
                for a in range(row["first"], row["last"], step):
                    b, lead = min(a + step, row["last"]), max(a - rate, 0)
                    x = np.concatenate([c for _, c in wav._chunks(row | {"first": lead, "last": min(b + 6, row["frames"])})])
                    own = slice(a - lead, b - lead)
                    power = (filtered(x, impulse(rate))[own] ** 2) @ weights(row["channels"])
                    number, at = wav._folded(power, a, hop)
                    yield pa.RecordBatch.from_arrays([pa.array([row["path"]] * len(number)), pa.array(number.astype(np.int64)), pa.array(np.add.reduceat(power, at)), pa.array([hop] * len(number), pa.int64()), pa.array(np.maximum.reduceat(true_peak(x, rate)[own], at))], names=[c.split()[0] for c in SCHEMA.split(", ")])

    ship(layout_rows.sparkSession)
    parts = wav.ranges(layout_rows, size).mapInArrow(run, SCHEMA)
    hops = parts.groupBy("path", "hop").agg(F.sum("weighted").alias("weighted"), F.max("frames").alias("frames"), F.max("peak").alias("peak"))
    block = Window.partitionBy("path").orderBy("hop").rowsBetween(-3, 0)
    return hops.select("path", "hop", (F.sum("weighted").over(block) / (4 * F.col("frames"))).alias("energy"), "peak")
