"""Column functions on levels, sizes, frames, profiles and MPEG frame headers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Average kbps of the VBR presets 0 to 9.
VBR_KBPS = [245, 225, 190, 175, 165, 130, 115, 100, 85, 65]
#: Layer III kbps by index 1 to 14, for MPEG 1 and for MPEG 2 and 2.5; rates of MPEG 1, which 2 halves and 2.5 quarters.
KBPS_1 = [32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320]
KBPS_2 = [8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160]
RATES = [44100, 48000, 32000]
#: Seconds between the ticks of a ruler.
TICKS = [0.1, 0.2, 0.5, 1.0, 2.0, 5.0, 10.0, 15.0, 30.0, 60.0, 120.0, 300.0, 600.0]
#: A decoder's delay, the largest value of a trim field, and the frames decoded ahead of a cut.
DECODER_DELAY, TRIM_MOST, AHEAD = 529, 4095, 2


def loudness(energy: Column) -> Column:
    return -0.691 + 10 * F.log10(energy)


def energy(lufs: Column) -> Column:
    return F.pow(F.lit(10.0), (lufs + 0.691) / 10)


def decibels(peak: Column) -> Column:
    return 20 * F.log10(F.greatest(peak, F.lit(1e-10)))


def amplitude(gain: Column) -> Column:
    return F.pow(F.lit(10.0), gain / 20)


def normalise_gain(lufs: Column, peak_db: Column, target: float, ceiling: float = -1.0) -> Column:
    """Up or down to the target, never above the ceiling; silence (null) stays as it is."""
    return F.when(lufs.isNull(), 0.0).otherwise(F.least(target - lufs, ceiling - peak_db))


def quantise(x: Column, bits: int) -> Column:
    full = 1 << (bits - 1)
    return F.greatest(F.least(F.round(x * full), F.lit(float(full - 1))), F.lit(float(-full))).cast("long")


def vbr_kbps(quality: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, VBR_KBPS)), (F.least(quality, F.lit(9)) + 1).cast("int"))


def effective(profile: Column, copyable: Column) -> Column:
    """Profiles are original, mp3_vbr, mp3_cbr, flac and wav16; what can't be copied as it is becomes flac."""
    return F.when((profile == "original") & ~copyable, "flac").otherwise(profile)


def is_lossy(profile: Column) -> Column:
    return profile.isin("mp3_vbr", "mp3_cbr")


def extension(profile: Column, source: Column) -> Column:
    return F.when(is_lossy(profile), "mp3").when(profile == "flac", "flac").when(profile == "wav16", "wav").otherwise(source)


def target_kbps(profile: Column, setting: Column) -> Column:
    return F.when(profile == "mp3_vbr", vbr_kbps(setting)).when(profile == "mp3_cbr", setting)


def estimate_bytes(profile: Column, setting: Column, facts: dict[str, Column], secs: Column) -> Column:
    """``facts``: copyable, kbps, rate, channels and bits (null if unknown) of the source."""
    used, pcm = effective(profile, facts["copyable"]), facts["rate"] * facts["channels"] * 2.0 * secs
    depth = F.greatest(F.coalesce(facts["bits"] / 16.0, F.lit(1.0)), F.lit(1.0))
    size = F.when(used == "original", facts["kbps"] * 125.0 * secs).when(is_lossy(used), target_kbps(used, setting) * 125.0 * secs).when(used == "flac", pcm * depth * 0.58).otherwise(pcm)
    return size.cast("long")


def warnings(profile: Column, setting: Column, facts: dict[str, Column]) -> Column:
    """Array of what to know before an export; ``facts`` also has lossy."""
    lossy, coded, changed = facts["lossy"], is_lossy(profile), effective(profile, facts["copyable"]) != profile
    rules = [
        (changed, "not copyable"),
        (lossy & profile.isin("flac", "wav16"), "lossless from lossy"),
        (lossy & coded, "encoded again"),
        (lossy & coded & (target_kbps(profile, setting) > facts["kbps"] * 1.15), "bitrate above source"),
        ((profile == "wav16") & F.coalesce(facts["bits"] > 16, F.lit(False)), "fewer bits"),
        (coded & (facts["rate"] > 48_000), "resampled"),
    ]
    return F.filter(F.array(*[F.when(rule, text) for rule, text in rules]), lambda w: w.isNotNull())


def video_seconds(frame: Column, rate: Column, delay: Column) -> Column:
    return F.greatest(frame / rate - delay, F.lit(0.0))


def video_frame(secs: Column, rate: Column, delay: Column) -> Column:
    return F.round((secs + delay) * rate).cast("long")


def rescale(frame: Column, denominator: Column, numerator: Column, rate: Column) -> Column:
    """frame * denominator div (numerator * rate), exact beyond 64 bits."""
    wide = lambda c: c.cast("decimal(19,0)")
    return F.floor(wide(frame) * wide(denominator) / (wide(numerator) * wide(rate))).cast("long")


def tick_step(span: Column) -> Column:
    return F.coalesce(F.get(F.filter(F.array(*map(F.lit, TICKS)), lambda s: span / s <= 10), F.lit(0)), F.lit(1200.0))


def ticks(start: Column, span: Column) -> Column:
    """Array of a ruler's ticks in seconds: multiples of the step in the view, without those at its far right."""
    step = tick_step(span)
    number = F.sequence(F.ceil(start / step).cast("long"), F.greatest(F.floor((start + span) / step), F.ceil(start / step)).cast("long"))
    return F.filter(F.transform(number, lambda k: k * step), lambda t: (t <= start + span) & ((t - start) / span * 100 < 96))


def view_window(pos: Column, total: Column, length: Column) -> Column:
    """Start and stop of so much audio at a place, drawn in at the recording's end."""
    start = F.least(pos, F.greatest(total - length, F.lit(0)))
    return F.struct(start.alias("start"), F.least(start + length, total).alias("stop"))


def pixel_frame(x: Column, left: Column, width: Column, start: Column, span: Column) -> Column:
    share = F.greatest(F.least((x - left) / F.greatest(width, F.lit(1.0)), F.lit(1.0)), F.lit(0.0))
    return (start + (share * span).cast("long")).cast("long")


def cut_fields(start: Column, stop: Column, spf: Column, frames: Column) -> Column:
    """(first, frames, carrier, delay, padding) of a lossless cut of MPEG frames, of any start and stop.

    Two frames ahead of the cut are copied, and before those goes a carrier frame unless they begin the file. Where a
    cut begins beyond the file, ``frames`` falls below two and may be negative.
    """
    at = F.floor(start / spf).cast("long")
    first = F.greatest(at - AHEAD, F.lit(0))
    carrier = first > 0
    lead = first * spf - F.when(carrier, spf).otherwise(0)
    delay = F.greatest(start - lead - DECODER_DELAY, F.lit(0))
    copied = F.least(F.ceil(stop / spf).cast("long"), frames) - first
    keep = F.greatest(stop - (lead + delay + DECODER_DELAY), F.lit(0))
    padding = F.least(F.greatest((copied + carrier.cast("long")) * spf - delay - keep, F.lit(0)), F.lit(TRIM_MOST))
    parts = {"first": first, "frames": copied, "carrier": carrier, "delay": delay, "padding": padding}
    return F.struct(*[v.cast("boolean" if k == "carrier" else "long").alias(k) for k, v in parts.items()])


def cut_plan(start: Column, stop: Column, spf: Column, frames: Column) -> Column:
    """The fields of a cut; null for an empty track, which a cut beyond the file is too."""
    return F.when((stop > start) & (start < spf * frames), cut_fields(start, stop, spf, frames))


def frame_header(word: Column) -> Column:
    """(version, rate, kbps, channels, length, samples, side) of a Layer III header as a 32-bit number; else null.

    ``version`` is 1, 2 or 25 (2.5); free format and reserved values are null. ``side``: bytes of side information.
    """
    bits = lambda low, count: F.shiftrightunsigned(word, low).bitwiseAND((1 << count) - 1)
    pick = lambda values, at: F.get(F.array(*map(F.lit, values)), at.cast("int"))
    version = F.when(bits(19, 2) == 3, 1).when(bits(19, 2) == 2, 2).when(bits(19, 2) == 0, 25)
    one = version == 1
    kbps = F.when(one, pick(KBPS_1, bits(12, 4) - 1)).otherwise(pick(KBPS_2, bits(12, 4) - 1))
    rate = F.floor(pick(RATES, bits(10, 2)) / F.when(one, 1).when(version == 2, 2).otherwise(4)).cast("int")
    samples, channels = F.when(one, 1152).otherwise(576), F.when(bits(6, 2) == 3, 1).otherwise(2)
    length = (F.floor(samples / 8 * kbps * 1000 / rate) + bits(9, 1)).cast("int")
    side = F.when(one, F.when(channels == 1, 17).otherwise(32)).otherwise(F.when(channels == 1, 9).otherwise(17))
    valid = (bits(21, 11) == 0x7FF) & version.isNotNull() & (bits(17, 2) == 1) & ~bits(12, 4).isin(0, 15) & (bits(10, 2) != 3)
    fields = {"version": version, "rate": rate, "kbps": kbps, "channels": channels, "length": length, "samples": samples, "side": side}
    return F.when(valid, F.struct(*[v.cast("int").alias(k) for k, v in fields.items()]))
