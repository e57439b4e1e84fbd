"""Column functions on names, titles, versions, headers and labels. A null input gives a null result unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space as Unicode has it, not only the ASCII space that trim() takes.
_SPACE = r"[\p{Z}\s]"
_TIME = r"[0-9]{1,2}(?::[0-9]{1,2}){1,2}"
_TOKEN = rf"(?:[0-9]{{1,3}}|{_TIME})"
_LEAD = rf"^(?:[-–—.):|•*#]|{_SPACE}|(?:{_TOKEN}(?![0-9:])|[\[(]{_SPACE}*{_TOKEN}{_SPACE}*[\])])(?=\z|{_SPACE}|[-.–—):|]))++"
#: What an error's text contains, in the order in which they are tried, and the kind of error.
ERRORS = [
    (("Requested format is not available",), "no such format"),
    (("members-only", "Join this channel"), "members only"),
    (("Private video",), "private"),
    (("Video unavailable", "not available in your country"), "removed"),
    (("Sign in to confirm", "not a bot", "HTTP Error 403"), "refused"),
]
AUDIO, VIDEO = ("mp3", "wav"), ("mp4", "m4v", "mov")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{_SPACE}+|{_SPACE}+$", "")


def clock_precise(secs: Column) -> Column:
    """h:mm:ss.mmm, or mm:ss.mmm under an hour; rounded to a millisecond, negative as 0."""
    ms = F.round(F.when(secs < 0, 0.0).otherwise(secs) * 1000).cast("long")
    tail = F.format_string("%02d:%02d.%03d", _div(ms, 60_000) % 60, _div(ms, 1000) % 60, ms % 1000)
    return F.when(ms >= 3_600_000, F.concat(_div(ms, 3_600_000).cast("string"), F.lit(":"), tail)).when(ms.isNotNull(), tail)


def clock_short(secs: Column) -> Column:
    """h:mm:ss or m:ss; rounded to a millisecond first, then cut to a second."""
    s = _div(F.round(F.when(secs < 0, 0.0).otherwise(secs) * 1000).cast("long"), 1000)
    return F.when(s >= 3600, F.format_string("%d:%02d:%02d", _div(s, 3600), _div(s, 60) % 60, s % 60)).when(s.isNotNull(), F.format_string("%d:%02d", _div(s, 60), s % 60))


def size_label(size: Column) -> Column:
    unit = lambda limit, form: F.format_string(form, size / limit)
    return F.when(size >= 1e9, unit(1e9, "%.1f GB")).when(size >= 1e6, unit(1e6, "%.0f MB")).when(size.isNotNull(), unit(1e3, "%.0f kB"))


def sanitize(name: Column) -> Column:
    """A file name that is safe on common systems: at most 180 characters, never empty."""
    safe = strip(F.regexp_replace(name, r'[/\\:*?"<>|\p{Cc}]', "_"))
    short = F.substring(strip(F.regexp_replace(safe, r"^\.+|\.+$", "")), 1, 180)
    return F.when(short == "", "untitled").otherwise(short)


def track_stem(template: Column, number: Column, total: Column, title: Column, source: Column) -> Column:
    """The template's marks one after another, so that a title's own marks are filled in too; then sanitized."""
    width, digits = F.greatest(F.lit(2), F.length(total.cast("string"))), number.cast("string")
    padded = F.concat(F.repeat(F.lit("0"), F.greatest(width - F.length(digits), F.lit(0))), digits)
    named = F.replace(F.replace(template, F.lit("{nn}"), padded), F.lit("{n}"), digits)
    return sanitize(F.replace(F.replace(named, F.lit("{title}"), title), F.lit("{source}"), source))


def renamed(path: Column, stem: Column) -> Column:
    """The path with another stem and its own extension; null if that changes nothing."""
    folder, name = F.regexp_extract(path, r"^(.*/)?[^/]*$", 1), F.regexp_extract(path, r"([^/]*)$", 1)
    to = F.concat(folder, sanitize(stem), F.regexp_extract(name, r"^.+(\.[^.]*)$", 1))
    return F.when(to != path, to)


def clean_title(line: Column) -> Column:
    """A tracklist line without leading numbers, times and separators and without a trailing length."""
    s = F.regexp_replace(F.regexp_replace(strip(line), _LEAD, ""), rf"{_SPACE}+$", "")
    for bracketed in (rf"{_SPACE}*\({_SPACE}*{_TIME}{_SPACE}*\)$", rf"{_SPACE}*\[{_SPACE}*{_TIME}{_SPACE}*\]$", rf"{_SPACE}+{_TIME}$"):
        s = F.regexp_replace(s, bracketed, "")
    return strip(F.regexp_replace(s, r"[-–—|]+$", ""))


def titles(text: Column) -> Column:
    """Array of the titles in a pasted tracklist, one for each line that has one."""
    return F.filter(F.transform(F.split(text, r"\r?\n"), clean_title), lambda t: t != "")


def is_time(text: Column) -> Column:
    return text.rlike(rf"^{_TIME}\z")


def version(text: Column) -> Column:
    """(major, minor, patch), which compare as versions do; null where the text is none."""
    pattern = r"^v*([0-9]+)\.([0-9]+)\.([0-9]+)([-+.].*)?$"
    part = lambda k: F.regexp_extract(text, pattern, k).try_cast("int")
    return F.when(part(1).isNotNull() & part(2).isNotNull() & part(3).isNotNull(), F.array(part(1), part(2), part(3)))


def newer(a: Column, b: Column) -> Column:
    return F.coalesce(version(a) > version(b), F.lit(False))


def published(number: Column, date: Column) -> Column:
    return number.rlike(r"^[0-9]+\.[0-9]+\.[0-9]+$") & date.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$")


def clean_version(text: Column) -> Column:
    return F.when(text.rlike(r"^[0-9A-Za-z.-]{1,20}\z"), text).otherwise("unknown")


def byte_range(header: Column, size: Column) -> Column:
    """(first, last) of a Range header's first range, both included; no header is the whole; null: unsatisfiable."""
    spec = F.regexp_extract(F.trim(header), r"^bytes=([^,]*)", 1)
    pattern = r"^\s*([0-9]*)\s*-\s*([0-9]*)\s*$"
    a, b = (F.regexp_extract(spec, pattern, k).try_cast("decimal(38,0)") for k in (1, 2))
    last = size - 1
    first = F.when(header.isNull(), 0).when(~spec.rlike(pattern), None).when(a.isNull() & (b > 0), F.greatest(size - b, F.lit(0))).otherwise(a)
    end = F.when(header.isNull() | a.isNull() | b.isNull(), last).otherwise(F.least(b, last))
    return F.when((size > 0) & (first <= end) & (first < size), F.struct(first.cast("long").alias("first"), end.cast("long").alias("last")))


def progress(line: Column, prefix: str) -> Column:
    """(phase, fraction) of a line that has the prefix: ``finished``, or a word, bytes done, total and guessed total."""
    field = F.filter(F.split(F.substring(line, len(prefix) + 1, 1 << 30), r"\s+"), lambda f: f != "")
    number = lambda k: F.get(field, F.lit(k)).try_cast("double")
    total = F.coalesce(number(2), number(3))
    share = F.greatest(F.least(number(1) / F.when(total > 0, total), F.lit(1.0)), F.lit(0.0))
    done = F.get(field, F.lit(0)).eqNullSafe("finished")
    fraction = F.when(number(1).isNotNull() & (total > 0) & ~done, share)
    return F.when(line.startswith(prefix), F.struct(F.when(done, "converting").otherwise("downloading").alias("phase"), fraction.alias("fraction")))


def error_kind(text: Column) -> Column:
    out = F.lit(None).cast("string")
    for needles, kind in reversed(ERRORS):
        found = F.lit(False)
        for needle in needles:
            found = found | text.contains(needle)
        out = F.when(found, kind).otherwise(out)
    return out


def hex_word(text: Column) -> Column:
    """The first word of 64 hexadecimal digits, in lower case."""
    return F.get(F.filter(F.split(F.lower(text), rf"{_SPACE}+"), lambda w: w.rlike(r"^[0-9a-f]{64}\z")), F.lit(0))


def manifest_hash(manifest: Column, asset: Column) -> Column:
    """Of lines ``hash  name`` the hash of the first whose name is the asset's."""
    pair = F.transform(F.split(manifest, r"\r?\n"), lambda x: F.split(x, "  ", 2))
    hit = F.filter(pair, lambda p: (F.size(p) == 2) & (strip(F.get(p, F.lit(1))) == asset))
    return F.get(F.get(hit, F.lit(0)), F.lit(0))


def concat_filter(ranges: Column, sound: bool) -> Column:
    """ffmpeg's filter that trims each (start, stop) in seconds and joins them; ``ranges`` is an array of structs."""
    each = lambda form, n: F.array_join(F.transform(ranges, lambda r, i: F.format_string(form, *n(r, i))), "")
    index = lambda count: lambda r, i: [i] * count
    n = F.size(ranges).cast("string")
    trims = "[sv%d]trim=start=%.6f:end=%.6f,setpts=PTS-STARTPTS[v%d];"
    sounds = "[sa%d]atrim=start=%.6f:end=%.6f,asetpts=PTS-STARTPTS[a%d];"
    bounds = lambda r, i: [i, r["start"], r["stop"], i]
    heads = [F.lit("[0:v:0]split="), n, each("[sv%d]", index(1)), F.lit(";")]
    if sound:
        heads += [F.lit("[0:a:0]asplit="), n, each("[sa%d]", index(1)), F.lit(";")]
    body = each(trims + sounds, lambda r, i: bounds(r, i) * 2) if sound else each(trims, bounds)
    inputs = each("[v%d][a%d]", index(2)) if sound else each("[v%d]", index(1))
    return F.concat(*heads, body, inputs, F.lit("concat=n="), n, F.lit(":v=1:a=1[v][a]" if sound else ":v=1:a=0[v]"))


def utc_label(seconds: Column) -> Column:
    """Seconds since 1970 as yyyy-MM-ddTHH:mm:ssZ, whatever the session's time zone is; years from 10000 on have their digits and no sign."""
    day, rest = F.floor(seconds / 86_400), F.pmod(seconds, F.lit(86_400))
    date = F.date_add(F.lit("1970-01-01").cast("date"), day.cast("int"))
    year, tail = F.year(date), F.date_format(date, "-MM-dd")
    return F.concat(F.when(year > 9999, year.cast("string")).otherwise(F.date_format(date, "yyyy")), tail, F.format_string("T%02d:%02d:%02dZ", _div(rest, 3600), _div(rest, 60) % 60, rest % 60))


def wave_path(columns: Column) -> Column:
    """SVG outline of an array of (lo, hi) in -1 to 1: along the maxima, then back along the minima."""
    up = F.transform(columns, lambda c, i: F.format_string("L%d,%.2f", i, 49.7 - c["hi"] * 49.0))
    down = F.transform(columns, lambda c, i: F.format_string("L%d,%.2f", i, 50.3 - c["lo"] * 49.0))
    return F.concat(F.lit("M"), F.substring(F.array_join(F.concat(up, F.reverse(down)), ""), 2, 1 << 30), F.lit("Z"))


def path_token(target: Column) -> Column:
    return F.regexp_extract(F.regexp_extract(target, r"([^/]*)$", 1), r"^([^.?]*)", 1)


def media_kind(path: Column) -> Column:
    """audio, video or null, by the extension in any letter case."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when(ext.isin(*AUDIO), "audio").when(ext.isin(*VIDEO), "video")


def cleaned_names(wanted: DataFrame, taken: DataFrame) -> DataFrame:
    """(path, cleaned): the first of ``stem (cleaned).ext``, ``stem (cleaned 2).ext`` and so on that no path has.

    Both tables have one column path. Only taken names of that form are joined, on the stem.
    """
    form = r"^(.*) \(cleaned(?: ([0-9]+))?\)\.(wav|mp4)$"
    used = taken.select(F.regexp_extract("path", form, 1).alias("stem"), F.regexp_extract("path", form, 3).alias("ext"), F.regexp_extract("path", form, 2).try_cast("int").alias("k"))
    used = used.filter("ext <> '' AND (k IS NULL OR k > 1)").groupBy("stem", "ext").agg(F.collect_set(F.coalesce("k", F.lit(1))).alias("ks"))
    own = wanted.select("path", F.regexp_replace("path", r"(?<=[^/])\.[^./]*$", "").alias("stem"), F.when(media_kind(F.col("path")) == "video", "mp4").otherwise("wav").alias("ext"))
    k = F.array_min(F.array_except(F.sequence(F.lit(1), F.coalesce(F.size("ks"), F.lit(0)) + 1), F.coalesce("ks", F.array().cast("array<int>"))))
    joined = own.join(used, ["stem", "ext"], "left").withColumn("k", k)
    return joined.select("path", F.concat("stem", F.lit(" (cleaned"), F.when(F.col("k") > 1, F.concat(F.lit(" "), F.col("k").cast("string"))).otherwise(""), F.lit(")."), "ext").alias("cleaned"))


def _div(a: Column, b: int) -> Column:
    return F.floor(a / b).cast("long")
