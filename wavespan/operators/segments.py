"""Silent runs, split suggestions, tracks, and joins and unions of intervals.

Interval joins have the recording and a cell of frames as equi keys, so one long recording is many tasks' work and
no row meets all rows of its recording.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavespan.functions import texts

#: Frames to a cell of an interval join.
CELL = 1 << 16


def by_pos():
    return Window.partitionBy("rec").orderBy("pos")


def runs(flags: DataFrame, least: int) -> DataFrame:
    """(rec, s, e) in windows: maximal runs of quiet ones, by gaps and islands."""
    order = Window.partitionBy("rec").orderBy("win")
    island = flags.filter("quiet").select("rec", "win", (F.col("win") - F.row_number().over(order)).alias("island"))
    return island.groupBy("rec", "island").agg(F.min("win").alias("s"), (F.max("win") + 1).alias("e")).filter(F.col("e") - F.col("s") >= least).select("rec", "s", "e")


def tag(run_rows: DataFrame, ends: DataFrame, window: int, margin: int) -> DataFrame:
    """(rec, start, stop) in frames, drawn in by the margin but at the recording's ends."""
    own = run_rows.join(ends, "rec")
    start = F.when(F.col("s") == 0, 0).otherwise(F.col("s") * window + margin)
    stop = F.when(F.col("e") >= F.ceil(F.col("total") / window), F.col("total")).otherwise(F.greatest(F.col("e") * window - margin, F.lit(0)))
    return own.select("rec", start.cast("long").alias("start"), stop.cast("long").alias("stop")).filter("start < stop")


def suggest(run_rows: DataFrame, ends: DataFrame, window: int) -> DataFrame:
    """(rec, pos, len): the middle of each run that touches neither end."""
    own = run_rows.join(ends, "rec").filter((F.col("s") > 0) & (F.col("e") < F.ceil(F.col("total") / window)))
    return own.select("rec", F.floor((F.col("s") + F.col("e")) * window / 2).cast("long").alias("pos"), ((F.col("e") - F.col("s")) * window).cast("long").alias("len"))


def thin(suggestions: DataFrame, gap: int) -> DataFrame:
    """Of suggestions closer than the gap to the last one kept, the longer replaces it: a fold per recording."""
    rows = suggestions.groupBy("rec").agg(F.sort_array(F.collect_list(F.struct("pos", "len"))).alias("rows"))
    folded = F.expr(f"""aggregate(rows, cast(array() as array<struct<pos: bigint, len: bigint>>), (kept, x) -> CASE
        WHEN size(kept) = 0 OR x.pos - element_at(kept, -1).pos >= {gap} THEN concat(kept, array(x))
        WHEN x.len > element_at(kept, -1).len THEN concat(slice(kept, 1, size(kept) - 1), array(x)) ELSE kept END)""")
    return rows.select("rec", F.explode(folded).alias("x")).select("rec", "x.pos", "x.len")


def inside(points: DataFrame, at: str, intervals: DataFrame, lo: str = "lo", hi: str = "hi", cell: int = CELL) -> DataFrame:
    """Each point with each interval [lo, hi) of its recording that holds it, by cells that both are dealt to."""
    split = F.explode(F.sequence(F.floor(F.col(lo) / cell), F.floor((F.col(hi) - 1) / cell)))
    dealt = intervals.filter(F.col(lo) < F.col(hi)).withColumn("cell", split)
    return points.withColumn("cell", F.floor(F.col(at) / cell)).join(dealt, ["rec", "cell"]).filter((F.col(lo) <= F.col(at)) & (F.col(at) < F.col(hi))).drop("cell")


def near(points: DataFrame, at: str, others: DataFrame, pos: str, radius: int, cell: int = CELL) -> DataFrame:
    """Each point with each other position at most ``radius`` away."""
    around = others.withColumn("lo", F.col(pos) - radius).withColumn("hi", F.col(pos) + radius + 1)
    return inside(points, at, around, cell=cell).drop("lo", "hi")


def tracks(splits: DataFrame, ends: DataFrame) -> DataFrame:
    """(rec, idx, start, stop): consecutive and gap-free from 0 to the total; splits beyond it count as at the total."""
    starts = ends.select("rec", F.lit(0).cast("long").alias("pos")).unionByName(splits.select("rec", "pos"))
    clipped = starts.join(ends, "rec").withColumn("pos", F.least("pos", "total"))
    return clipped.select("rec", (F.row_number().over(by_pos()) - 1).cast("long").alias("idx"), F.col("pos").alias("start"), F.lead("pos").over(by_pos()).alias("next"), "total").select("rec", "idx", "start", F.coalesce("next", "total").alias("stop"))


def audible(track_rows: DataFrame, silences: DataFrame) -> DataFrame:
    """Tracks with their audio's bounds: of the silences that hold the first frame, or the last one, the first cuts."""
    cut = silences.filter("start < stop").select("rec", F.col("start").alias("lo"), F.col("stop").alias("hi"))
    keys = ["rec", "idx", "start", "stop"]
    edges = track_rows.select(*keys, F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(True).alias("first")), F.struct((F.col("stop") - 1).alias("at"), F.lit(False).alias("first")))).alias("e")).select("rec", "idx", "e.*")
    found = inside(edges, "at", cut).groupBy("rec", "idx").agg(F.min_by("hi", F.when(F.col("first"), F.col("lo"))).alias("hi"), F.min(F.when(~F.col("first"), F.col("lo"))).alias("lo"))
    own = track_rows.join(found, ["rec", "idx"], "left")
    a = F.least(F.coalesce("hi", "start"), F.col("stop"))
    return own.select(*keys, a.alias("audio_start"), F.greatest(F.greatest(F.coalesce("lo", "stop"), F.col("start")), a).alias("audio_stop"))


def left_out(audible_rows: DataFrame) -> DataFrame:
    """Of tracks (rec, start, stop, audio_start, audio_stop, exported), what an export leaves out, merged.

    Of an exported track that is what lies before and after its audio, of others all. Silence inside a track stays.
    """
    span = lambda a, b: F.struct(a.alias("start"), b.alias("stop"))
    start, stop = F.col("start"), F.col("stop")
    parts = F.when(F.col("exported"), F.array(span(start, F.col("audio_start")), span(F.col("audio_stop"), stop))).otherwise(F.array(span(start, stop)))
    return merge(audible_rows.select("rec", F.explode(parts).alias("p")).select("rec", "p.*").filter("start < stop"))


def merge(intervals: DataFrame) -> DataFrame:
    """Union of intervals (rec, start, stop); touching ones are one."""
    order = Window.partitionBy("rec").orderBy("start", "stop")
    before = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    flagged = intervals.select("rec", "start", "stop", F.when(before >= F.col("start"), 0).otherwise(1).alias("new"))
    numbered = flagged.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("rec", "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).select("rec", "start", "stop")


def complement(intervals: DataFrame, ends: DataFrame) -> DataFrame:
    """What disjoint intervals leave of [0, total)."""
    edges = intervals.select("rec", F.col("stop").alias("a"), F.col("start").alias("o")).unionByName(ends.select("rec", F.lit(0).cast("long").alias("a"), F.lit(-1).cast("long").alias("o")))
    nexts = edges.join(ends, "rec").withColumn("b", F.coalesce(F.lead("o").over(Window.partitionBy("rec").orderBy("o")), F.col("total")))
    return nexts.filter("a < b").select("rec", F.col("a").alias("start"), F.col("b").alias("stop"))


def rebase(intervals: DataFrame) -> DataFrame:
    """Start of each interval when they are put one after another."""
    before = Window.partitionBy("rec").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    return intervals.select("rec", "start", "stop", F.coalesce(F.sum(F.col("stop") - F.col("start")).over(before), F.lit(0)).cast("long").alias("out_start"))


def keep_by_overlap(new: DataFrame, old: DataFrame) -> DataFrame:
    """(rec, start, stop, keep): a silence is kept that overlaps a kept one of the old list.

    Two overlap if one holds the other's first frame.
    """
    kept = old.filter("keep AND start < stop").select("rec", F.col("start").alias("lo"), F.col("stop").alias("hi"))
    first = inside(new, "start", kept).select("rec", "start", "stop")
    other = inside(kept.select("rec", F.col("lo").alias("at")), "at", new, "start", "stop").select("rec", "start", "stop")
    hit = first.unionByName(other).distinct().withColumn("keep", F.lit(True))
    return new.join(hit, ["rec", "start", "stop"], "left").select("rec", "start", "stop", F.coalesce("keep", F.lit(False)).alias("keep"))


def far(found: DataFrame, fixed: DataFrame, gap: int) -> DataFrame:
    """Found positions (rec, pos) with no fixed one closer than the gap."""
    hit = near(found.select("rec", "pos"), "pos", fixed.select("rec", F.col("pos").alias("fixed")), "fixed", gap - 1).select("rec", "pos").distinct()
    return found.join(hit, ["rec", "pos"], "left_anti")


def with_titles(found: DataFrame, old: DataFrame, gap: int) -> DataFrame:
    """Found positions with the title of the first old split closer than the gap that has one, or null."""
    own = old.filter("title <> ''").select("rec", F.col("pos").alias("old"), "title")
    first = near(found.select("rec", "pos"), "pos", own, "old", gap - 1).groupBy("rec", "pos").agg(F.min_by("title", "old").alias("title"))
    return found.join(first, ["rec", "pos"], "left")


def redetected(splits: DataFrame, found: DataFrame, gap: int) -> DataFrame:
    """(rec, pos, idx, confirmed, title): confirmed splits, and found ones far from these with the old ones' titles."""
    fixed = splits.filter("confirmed").select("rec", "pos", "confirmed", "title")
    new = with_titles(far(found.select("rec", "pos").distinct(), fixed, gap), splits.filter("NOT confirmed"), gap)
    both = fixed.unionByName(new.select("rec", "pos", F.lit(False).alias("confirmed"), F.coalesce("title", F.lit("")).alias("title")))
    return both.withColumn("idx", (F.row_number().over(by_pos()) - 1).cast("long"))


def unique_stems(named: DataFrame) -> DataFrame:
    """(rec, number, stem) where a stem that an earlier final one equals, ASCII case aside, has its number added.

    The result isn't checked again. A fold over the tracks of a recording, of which there are hundreds.
    """
    low = lambda c: f"translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    rows = named.groupBy("rec").agg(F.sort_array(F.collect_list(F.struct("number", "stem"))).alias("rows"))
    fold = F.expr(f"""aggregate(rows, cast(array() as array<struct<number: bigint, stem: string>>), (done, x) -> concat(done, array(named_struct('number', cast(x.number as bigint), 'stem',
        CASE WHEN exists(done, d -> {low("d.stem")} = {low("x.stem")}) THEN concat(x.stem, ' (', x.number, ')') ELSE x.stem END))))""")
    return rows.select("rec", F.explode(fold).alias("x")).select("rec", "x.number", "x.stem")


def export_plan(exported: DataFrame, template: str, source, number=None) -> DataFrame:
    """(rec, number, title, stem) of exported tracks (rec, number, of, title): each with its name and file stem.

    An untitled track is called by its number. ``number`` is what the template shows, if it isn't the track's own.
    """
    title = F.when(F.trim("title") == "", F.concat(F.lit("Track "), "number")).otherwise(F.trim("title"))
    named = exported.withColumn("title", title)
    stem = texts.track_stem(F.lit(template), F.col("number") if number is None else number, F.col("of"), F.col("title"), source)
    return unique_stems(named.select("rec", "number", stem.alias("stem"))).join(named.select("rec", "number", "title"), ["rec", "number"])


def snap(splits: DataFrame, window_rows: DataFrame, window: int, radius: int) -> DataFrame:
    """The quietest window within ``radius`` windows, by level: nearest first, then lowest; the own one if as quiet.

    A position beyond the last window has that one as its own.
    """
    last = window_rows.groupBy("rec").agg(F.max("win").alias("last"))
    at = splits.join(last, "rec").select("rec", "pos", F.least(F.floor(F.col("pos") / window).cast("long"), "last").alias("own"))
    level = window_rows.select("rec", "win", (F.col("ss") / F.col("n")).alias("level"))
    far = F.abs(F.col("win") - F.col("own"))
    best = near(level, "win", at, "own", radius, 1 << 10).groupBy("rec", "pos", "own").agg(F.min(F.struct("level", far.alias("far"), "win")).alias("m"), F.min(F.when(far == 0, F.col("level"))).alias("here"))
    moved = F.when(F.col("here") <= F.col("m.level"), F.col("pos")).otherwise(F.col("m.win") * window + window // 2)
    return best.select("rec", "pos", moved.cast("long").alias("snapped"))
