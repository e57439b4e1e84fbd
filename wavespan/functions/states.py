"""Column functions on labels, flags, statuses, detection settings and the view, and the two table rules that go with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavespan.functions import numbers, texts

#: View spans in seconds, the highest threshold in dB and its step, the least silence in seconds and its step.
LEAST_SPAN, MOST_SPAN = 2.0, 600.0
MOST_THRESHOLD, THRESHOLD_STEP = -6.0, 3.0
LEAST_SILENCE, SILENCE_STEP = 0.25, 0.25
#: Rows and bytes of one request of the queue, with a line's end counted.
BATCH_ROWS, BATCH_BYTES = 200, 4000
#: Exports that are still under way.
ACTIVE = ("queued", "measuring", "installing", "running")


def flac_depth(bits: Column) -> Column:
    """24 bits for more than 16, else 16, also where the bits are unknown."""
    return F.when(bits > 16, 24).otherwise(16)


def profile_label(profile: Column, setting: Column) -> Column:
    number = setting.cast("string")
    return (
        F.when(profile == "original", "Original (lossless copy)")
        .when(profile == "mp3_vbr", F.concat(F.lit("MP3 VBR V"), number, F.lit(" (~"), numbers.vbr_kbps(setting).cast("string"), F.lit(" kbps)")))
        .when(profile == "mp3_cbr", F.concat(F.lit("MP3 CBR "), number, F.lit(" kbps")))
        .when(profile == "flac", "FLAC (lossless)")
        .when(profile == "wav16", "WAV 16-bit")
    )


def profile_short(profile: Column, setting: Column) -> Column:
    number = setting.cast("string")
    vbr, cbr = F.concat(F.lit("MP3 V"), number), F.concat(F.lit("MP3 "), number, F.lit("k"))
    return F.when(profile == "original", "Original").when(profile == "mp3_vbr", vbr).when(profile == "mp3_cbr", cbr).when(profile == "flac", "FLAC").when(profile == "wav16", "WAV 16")


def video_label(crf: Column) -> Column:
    quality = F.when(crf <= 18, "high quality").when(crf <= 23, "standard").when(crf.isNotNull(), "small files")
    return F.concat(F.lit("MP4 · "), quality)


def loudness_label(mode: Column, target: Column) -> Column:
    whom = F.when(mode == "album", "Whole recording").when(mode == "track", "Each track")
    return F.when(mode == "off", "Loudness unchanged").otherwise(F.concat(whom, F.lit(" to "), target.cast("string"), F.lit(" LUFS")))


def flag(value: Column) -> Column:
    """False for null, empty, 0, false and no in any letter case; true for any other text."""
    word = F.lower(texts.strip(value))
    return F.coalesce(~word.isin("", "0", "false", "no"), F.lit(False))


def may_send(endpoint: Column, blocked: Column, answer: Column, informed: Column, default: bool = True) -> Column:
    """An answer counts; without one the default does, once the person has been informed."""
    return endpoint.isNotNull() & ~blocked & F.coalesce(answer, informed & F.lit(default))


def accepted_title(typed: Column, suggested: Column, accept: Column) -> Column:
    """What is saved: the suggestion where nothing is typed and it is accepted; without outer white space."""
    return texts.strip(F.when(accept & (texts.strip(typed) == ""), suggested).otherwise(typed))


def source_facts(kind: Column, kbps: Column, size: Column, secs: Column) -> Column:
    """(kbps, lossy); ``kbps`` is the mean of a variable bitrate. An unknown one follows from size and length, cut to an integer."""
    known = kind.isin("cbr", "vbr", "avg", "pcm")
    guess = F.floor(size * 8 / 1000 / F.greatest(secs, F.lit(1.0))).cast("long")
    return F.struct(F.when(known, kbps.cast("long")).otherwise(guess).alias("kbps"), (kind != "pcm").alias("lossy"))


def bitrate_label(kind: Column, kbps: Column, least: Column, most: Column) -> Column:
    n, unit = kbps.cast("string"), F.lit(" kbps")
    spread = F.concat(F.lit("VBR "), least.cast("string"), F.lit("–"), most.cast("string"), F.lit(" kbps (avg "), n, F.lit(")"))
    return F.when(kind == "cbr", F.concat(F.lit("CBR "), n, unit)).when(kind == "vbr", spread).when(kind == "pcm", F.concat(n, unit)).when(kind == "avg", F.concat(F.lit("~"), n, unit)).when(kind == "unknown", "bitrate unknown").otherwise("")


def chips(codec: Column, bitrate: Column, rate: Column, channels: Column, secs: Column, size: Column, silent: Column) -> Column:
    """Array of a recording's short labels; one without sound has no bitrate, rate and channels."""
    layout = F.when(channels == 1, "mono").when(channels == 2, "stereo").otherwise(F.concat(channels.cast("string"), F.lit(" ch")))
    length, megabytes = texts.clock_short(secs), F.format_string("%.1f MB", F.bround(size / 1_048_576.0, 1))  # the quotient is exact, its halves go to the even digit
    return F.when(silent, F.array(codec, length, megabytes)).otherwise(F.array(codec, bitrate, F.format_string("%.1f kHz", rate / 1000.0), layout, length, megabytes))


def export_fraction(state: Column, done: Column, total: Column, part: Column) -> Column:
    """Share of a running export; null for others."""
    return F.when(state == "running", (done + part) / F.greatest(total, F.lit(1)))


def is_active(state: Column) -> Column:
    return F.coalesce(state.isin(*ACTIVE), F.lit(False))


def status_after(status: Column, action: Column) -> Column:
    """A recording's status after select, flag, finish or exported; other actions leave it."""
    flagged = F.when(status == "Flagged", "InProgress").otherwise("Flagged")
    return F.when((action == "select") & (status == "Todo"), "InProgress").when(action == "flag", flagged).when(action == "finish", "Done").when(action == "exported", "Exported").otherwise(status)


def status_after_all(status: Column, actions: Column) -> Column:
    """The same over an array of actions, in order."""
    return F.aggregate(actions, status, status_after)


def detect_settings(threshold: Column, silence: Column, action: Column) -> Column:
    """(threshold, silence) after quieter, louder, shorter or longer."""
    level = F.when(action == "quieter", threshold - THRESHOLD_STEP).when(action == "louder", F.least(threshold + THRESHOLD_STEP, F.lit(MOST_THRESHOLD))).otherwise(threshold)
    length = F.when(action == "shorter", F.greatest(silence - SILENCE_STEP, F.lit(LEAST_SILENCE))).when(action == "longer", silence + SILENCE_STEP).otherwise(silence)
    return F.struct(level.alias("threshold"), length.alias("silence"))


def detection_step(detected: Column, tagged: Column) -> Column:
    """What a recording still needs: nothing, silences only, or suggestions and silences."""
    return F.when(~detected, "detect and tag").when(~tagged, "tag").otherwise("nothing")


# ---- the view: ``start`` and ``span`` in frames ------------------------------------------------


def _held(start: Column, span: Column, total: Column) -> Column:
    return F.greatest(F.least(start, total - span), F.lit(0)).cast("long")


def _part(span: Column, percent: int) -> Column:
    return F.floor(span * percent / 100).cast("long")


def revealed(start: Column, span: Column, total: Column, frame: Column, centre: bool) -> Column:
    """The view's start so that a frame shows: in its middle, or a tenth from its left edge if it was outside."""
    moved = _held(frame - _part(span, 50 if centre else 10), span, total)
    return moved if centre else F.when((frame >= start) & (frame < start + span), start).otherwise(moved)


def scrolled(start: Column, span: Column, total: Column, frames: Column) -> Column:
    return _held(start + frames, span, total)


def followed(start: Column, span: Column, total: Column, pos: Column) -> Column:
    """A page on once the playhead is before the view or in its last 3 %."""
    return F.when((pos < start) | (pos >= start + _part(span, 97)), _held(pos - _part(span, 3), span, total)).otherwise(start)


def zoomed(start: Column, secs: Column, total: Column, rate: Column, pos: Column, factor: Column) -> Column:
    """(start, secs): the playhead keeps its place on screen, or the middle does where it isn't on screen."""
    most = F.greatest(F.least(F.lit(MOST_SPAN), total / rate), F.lit(LEAST_SPAN))
    span, wide = F.greatest(F.least(secs * factor, most), F.lit(LEAST_SPAN)), secs * rate
    anchor = F.when((pos >= start) & (pos < start + wide), pos.cast("double")).otherwise(start + wide / 2)
    first = F.floor(F.greatest(anchor - (anchor - start) / wide * span * rate, F.lit(0.0))).cast("long")
    return F.struct(_held(first, F.floor(span * rate).cast("long"), total).alias("start"), span.alias("secs"))


# ---- tables ----------------------------------------------------------------------------------


def toggled(tracks: DataFrame, presses: DataFrame) -> DataFrame:
    """tracks (rec, idx, dropped) after presses (rec, idx): an odd number of them turns a track; those of no track count nothing."""
    odd = presses.groupBy("rec", "idx").agg((F.count(F.lit(1)) % 2 == 1).alias("odd"))
    return tracks.join(odd, ["rec", "idx"], "left").select("rec", "idx", (F.col("dropped") != F.coalesce("odd", F.lit(False))).alias("dropped"))


def next_batch(lines: DataFrame, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> DataFrame:
    """(queue, seq, line) of each queue's oldest lines that fit into a request; the first always goes.

    The window sums over one queue; a queue is one installation's file.
    """
    order = Window.partitionBy("queue").orderBy("seq")
    used = F.sum(F.octet_length("line") + 1).over(order.rowsBetween(Window.unboundedPreceding, 0))
    numbered = lines.select("queue", "seq", "line", F.row_number().over(order).alias("k"), used.alias("used"))
    return numbered.filter((F.col("k") <= rows) & ((F.col("k") == 1) | (F.col("used") <= size))).select("queue", "seq", "line")


def sidebar(recordings: DataFrame, edits: DataFrame, scans: DataFrame, exports: DataFrame) -> DataFrame:
    """(rec, status): a running or failed export first, then the scan's state, then counts of splits, else the length.

    recordings (rec), edits (rec, confirmed, open), scans (rec, scan, progress, secs), exports (rec, export, done,
    of); a rec is at most once in each of the last three. An edit without splits counts as none.
    """
    all_ = recordings.join(edits, "rec", "left").join(scans, "rec", "left").join(exports, "rec", "left")
    c, text = F.col, lambda n: F.col(n).cast("string")
    splits = F.coalesce(c("confirmed") + c("open"), F.lit(0))
    ready = F.when(splits == 0, texts.clock_short(c("secs"))).when(c("open") == 0, F.concat((c("confirmed") + 1).cast("string"), F.lit(" tracks ✓"))).otherwise(F.concat(text("open"), F.lit(" to review")))
    scan = F.when(c("scan") == "scanning", F.concat(F.floor(c("progress") * 100).cast("string"), F.lit("%"))).when(c("scan") == "failed", "error").when(c("scan") == "ready", ready).otherwise("…")
    export = F.when(c("export") == "queued", "queued").when(c("export") == "measuring", "measuring…").when(c("export") == "installing", "installing ffmpeg…").when(c("export") == "failed", "export failed")
    running = F.concat(F.lit("exporting "), text("done"), F.lit("/"), text("of"))
    return all_.select("rec", F.when(c("export") == "running", running).otherwise(F.coalesce(export, scan)).alias("status"))
