"""Queries over recordings, each with SQL that computes the same rows another way where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavespan.functions import texts
from wavespan.operators import levels, segments
from wavespan.plans.recording import BASE, FACTOR, FULL, GAP, HOP, LEAST, LEVELS, MARGIN, QUIET, WINDOW, Recording
from wavespan.sources import signal as source

CTE = f"""WITH RECURSIVE signal AS (
  SELECT event_type AS rec, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS frame, CAST(round(value * 100) AS BIGINT) AS cents FROM events),
ends AS (SELECT rec, count(*) AS total FROM signal GROUP BY rec),
win AS (SELECT rec, frame // {WINDOW} AS win, CAST(sum(cents * cents) AS BIGINT) AS ss, count(*) AS n FROM signal GROUP BY ALL),
flag AS (SELECT *, ss < {QUIET}::BIGINT * {QUIET} * n AS quiet FROM win),
edge AS (SELECT *, sum(CASE WHEN quiet AND NOT coalesce(before, false) THEN 1 ELSE 0 END) OVER (PARTITION BY rec ORDER BY win) AS k FROM (SELECT *, lag(quiet) OVER (PARTITION BY rec ORDER BY win) AS before FROM flag)),
runs AS (SELECT rec, min(win) AS s, max(win) + 1 AS e FROM edge WHERE quiet GROUP BY rec, k HAVING count(*) >= {LEAST}),
silences AS (SELECT rec, start, stop, start % 5 = 0 AS keep FROM (SELECT rec, CAST(CASE WHEN s = 0 THEN 0 ELSE s * {WINDOW} + {MARGIN} END AS BIGINT) AS start,
  CAST(CASE WHEN e * {WINDOW} >= total THEN total ELSE e * {WINDOW} - {MARGIN} END AS BIGINT) AS stop FROM runs JOIN ends USING (rec)) WHERE start < stop),
sug AS (SELECT rec, CAST((s + e) * {WINDOW} // 2 AS BIGINT) AS pos, CAST((e - s) * {WINDOW} AS BIGINT) AS len FROM runs JOIN ends USING (rec) WHERE s > 0 AND e * {WINDOW} < total),
nsug AS (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY pos) AS k FROM sug),
fold AS (SELECT rec, k, pos, len, pos AS kpos, len AS klen, 1 AS slot FROM nsug WHERE k = 1 UNION ALL
  SELECT n.rec, n.k, n.pos, n.len, CASE WHEN n.pos - f.kpos >= {GAP} OR n.len > f.klen THEN n.pos ELSE f.kpos END, CASE WHEN n.pos - f.kpos >= {GAP} OR n.len > f.klen THEN n.len ELSE f.klen END,
  f.slot + CASE WHEN n.pos - f.kpos >= {GAP} THEN 1 ELSE 0 END FROM fold f JOIN nsug n ON n.rec = f.rec AND n.k = f.k + 1),
thin AS (SELECT rec, arg_max(kpos, k) AS pos, arg_max(klen, k) AS len FROM fold GROUP BY rec, slot),
splits AS (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY pos) - 1 AS idx FROM thin),
splitc AS (SELECT *, idx % 3 = 0 AS confirmed FROM splits),
tracks AS (SELECT rec, row_number() OVER (PARTITION BY rec ORDER BY pos) - 1 AS idx, pos AS start, coalesce(lead(pos) OVER (PARTITION BY rec ORDER BY pos), total) AS stop
  FROM (SELECT rec, 0 AS pos FROM ends UNION ALL SELECT rec, least(pos, total) FROM splits JOIN ends USING (rec)) JOIN ends USING (rec)),
cuts AS (SELECT * FROM silences WHERE NOT keep),
aud0 AS (SELECT *, idx % 4 = 3 AS dropped, least(coalesce((SELECT min(c.stop) FROM cuts c WHERE c.rec = t.rec AND c.start <= t.start AND t.start < c.stop), t.start), t.stop) AS a,
  greatest(coalesce((SELECT min(c.start) FROM cuts c WHERE c.rec = t.rec AND c.start < t.stop AND t.stop <= c.stop), t.stop), t.start) AS b FROM tracks t),
aud AS (SELECT rec, idx, start, stop, dropped, a AS audio_start, greatest(a, b) AS audio_stop, NOT dropped AND greatest(a, b) > a AS exported FROM aud0),
audio AS (SELECT rec, idx, audio_start AS start, audio_stop AS stop FROM aud WHERE exported),
cleaned AS (SELECT *, CAST(sum(stop - start) OVER (PARTITION BY rec ORDER BY idx) - (stop - start) AS BIGINT) AS out_start, row_number() OVER (PARTITION BY rec ORDER BY idx) AS k FROM audio),
cover AS (SELECT s.rec, s.frame FROM signal s WHERE NOT EXISTS (SELECT 1 FROM audio c WHERE c.rec = s.rec AND c.start <= s.frame AND s.frame < c.stop)),
skipped AS (SELECT rec, min(frame) AS start, max(frame) + 1 AS stop FROM (SELECT *, frame - row_number() OVER (PARTITION BY rec ORDER BY frame) AS g FROM cover) GROUP BY rec, g),
kept AS (SELECT rec, min(frame) AS start, max(frame) + 1 AS stop FROM (SELECT *, frame - row_number() OVER (PARTITION BY rec ORDER BY frame) AS g FROM (SELECT rec, frame FROM signal EXCEPT SELECT rec, frame FROM cover)) GROUP BY rec, g),
hops AS (SELECT rec, frame // {HOP} AS hop_idx, sum(cents * cents) AS ss, count(*) AS n, max(abs(cents)) AS peak FROM signal GROUP BY ALL),
blocks AS (SELECT a.rec, a.hop_idx, sum(b.ss) AS ss, sum(b.n) AS n FROM hops a JOIN hops b ON a.rec = b.rec AND b.hop_idx BETWEEN a.hop_idx - 3 AND a.hop_idx WHERE a.hop_idx >= 3 GROUP BY ALL),
inblock AS (SELECT t.rec, t.idx, b.hop_idx, CAST(b.ss AS DOUBLE) / b.n / {FULL}e0 ** 2 AS energy FROM audio t JOIN blocks b ON b.rec = t.rec AND b.hop_idx >= ceil(t.start / {HOP}) + 3 AND b.hop_idx < floor(t.stop / {HOP})),
inpeak AS (SELECT t.rec, t.idx, h.peak / {FULL}e0 AS peak FROM audio t JOIN hops h ON h.rec = t.rec AND h.hop_idx >= floor(t.start / {HOP}) AND h.hop_idx < ceil(t.stop / {HOP}))
"""
#: Fixed values of EBU R 128: the absolute gate (-70 LUFS) as energy, and the share of the first mean that the second one is (-10 LU).
GATE, SHARE = "(10e0 ** ((-70 + 0.691) / 10))", 0.1
REGISTRY: dict[str, tuple] = {}


def query(name: str, sql: str | None = None, cte: bool = True):
    def register(f):
        REGISTRY[name] = (lambda spark, sf_dir: f(Recording(spark, sf_dir)), (CTE + sql if cte else sql) if sql else None)
        return f

    return register


OLD = "old AS (SELECT rec, CAST(start + (start % 11) - 5 AS BIGINT) AS start, CAST(stop - (start % 7) AS BIGINT) AS stop, start % 2 = 0 AS keep FROM silences)"


def old_silences(r: Recording) -> DataFrame:
    s = F.col("start")
    return r.silences.select("rec", (s + s % 11 - 5).alias("start"), (F.col("stop") - s % 7).alias("stop"), (s % 2 == 0).alias("keep"))


@query("a1_peaks", f"SELECT rec, frame // {BASE} AS bucket, min(cents) AS lo, max(cents) AS hi FROM signal GROUP BY ALL")
def a1(r: Recording) -> DataFrame:
    return levels.peak_pyramid(r.signal, BASE, FACTOR, 1).select("rec", "bucket", "lo", "hi")


@query("a2_window_rms", "SELECT rec, win, round(20 * log10(greatest(sqrt(ss::DOUBLE / n), 1e-9)), 6) AS db FROM win")
def a2(r: Recording) -> DataFrame:
    return r.windows.select("rec", "win", F.round(levels.decibels(F.col("ss") / F.col("n")), 6).alias("db"))


@query("a3_peak_pyramid", " UNION ALL ".join(f"SELECT rec, {k} AS level, frame // {BASE * FACTOR**k} AS bucket, min(cents) AS lo, max(cents) AS hi FROM signal GROUP BY ALL" for k in range(LEVELS)))
def a3(r: Recording) -> DataFrame:
    return levels.peak_pyramid(r.signal, BASE, FACTOR, LEVELS)


@query("a4_view_columns", f"SELECT rec, col, CAST(coalesce(min(cents), 0) AS BIGINT) AS lo, CAST(coalesce(max(cents), 0) AS BIGINT) AS hi FROM (SELECT rec, c.range AS col, floor(c.range * 25.0 / {BASE}) * {BASE} AS f0, greatest(ceil((c.range + 1) * 25.0 / {BASE}), floor(c.range * 25.0 / {BASE}) + 1) * {BASE} AS f1 FROM ends, range(40) c) LEFT JOIN signal s USING (rec) WHERE s.frame >= f0 AND s.frame < f1 GROUP BY rec, col UNION ALL SELECT rec, c.range, 0, 0 FROM ends, range(40) c WHERE floor(c.range * 25.0 / {BASE}) * {BASE} >= total")
def a4(r: Recording) -> DataFrame:
    return levels.columns(r.signal, 0, 1000, 40, BASE)


@query("p8_quiet_windows", "SELECT rec, count(*) AS n FROM flag WHERE quiet GROUP BY rec")
def p8(r: Recording) -> DataFrame:
    return r.windows.filter("quiet").groupBy("rec").agg(F.count(F.lit(1)).alias("n"))


@query("w2_silence_runs", "SELECT rec, s, e FROM runs")
def w2(r: Recording) -> DataFrame:
    return r.runs


@query("w17_tag_silences", "SELECT rec, start, stop FROM silences")
def w17(r: Recording) -> DataFrame:
    return r.silences.select("rec", "start", "stop")


@query("w16_suggestions", "SELECT rec, pos, len FROM sug")
def w16(r: Recording) -> DataFrame:
    return r.suggestions


@query("w4_thin_suggestions", "SELECT rec, pos, len FROM thin")
def w4(r: Recording) -> DataFrame:
    return r.splits.select("rec", "pos", "len")


@query("w1_tracks", "SELECT rec, idx, start, stop FROM tracks")
def w1(r: Recording) -> DataFrame:
    return r.tracks.drop("dropped")


@query("j11_adjacent_rows", "SELECT a.rec, a.start, (SELECT min(b.start) FROM silences b WHERE b.rec = a.rec AND b.start > a.start) - a.stop AS gap FROM silences a")
def j11(r: Recording) -> DataFrame:
    return r.silences.select("rec", "start", (F.lead("start").over(Window.partitionBy("rec").orderBy("start")) - F.col("stop")).alias("gap"))


@query("j4_track_audio", "SELECT rec, idx, audio_start, audio_stop FROM aud")
def j4(r: Recording) -> DataFrame:
    return r.audible.select("rec", "idx", "audio_start", "audio_stop")


@query("p2_exported_tracks", "SELECT rec, idx FROM aud WHERE exported")
def p2(r: Recording) -> DataFrame:
    return r.audible.filter("exported").select("rec", "idx")


@query("a12_skipped_union", "SELECT rec, start, stop FROM skipped")
def a12(r: Recording) -> DataFrame:
    return r.skipped


@query("w3_merge_islands", f"{CTE}, {OLD}, both_ AS (SELECT rec, start, stop FROM silences UNION ALL SELECT rec, start, stop FROM old WHERE start < stop), pts AS (SELECT DISTINCT rec, unnest(range(start, stop)) AS f FROM both_) SELECT rec, min(f) AS start, max(f) + 1 AS stop FROM (SELECT *, f - row_number() OVER (PARTITION BY rec ORDER BY f) AS g FROM pts) GROUP BY rec, g", cte=False)
def w3(r: Recording) -> DataFrame:
    """Two lists of silences as one: overlapping and touching ones become one."""
    return segments.merge(r.silences.select("rec", "start", "stop").unionByName(old_silences(r).drop("keep")).filter("start < stop"))


@query("u3_kept_complement", "SELECT rec, start, stop FROM kept")
def u3(r: Recording) -> DataFrame:
    return r.kept


@query("w5_rebase", "SELECT rec, start, stop, out_start FROM cleaned")
def w5(r: Recording) -> DataFrame:
    return segments.rebase(r.exported)


@query("u2_concatenate", "SELECT rec, out_start + frame - start AS frame, cents FROM cleaned JOIN signal USING (rec) WHERE frame >= start AND frame < stop")
def u2(r: Recording) -> DataFrame:
    """The samples of the exported tracks' audio, one track after another."""
    return segments.inside(r.signal, "frame", segments.rebase(r.exported), "start", "stop").select("rec", (F.col("out_start") + F.col("frame") - F.col("start")).alias("frame"), "cents")


@query("e12_cleaned_splits", "SELECT rec, out_start AS pos, 'Confirmed' AS state FROM cleaned WHERE k > 1")
def e12(r: Recording) -> DataFrame:
    return segments.rebase(r.exported).filter("out_start > 0").select("rec", F.col("out_start").alias("pos"), F.lit("Confirmed").alias("state"))


@query("w6_track_names", "SELECT rec, idx, CASE WHEN idx % 5 = 2 THEN 'Song ' || idx WHEN exported THEN 'Track ' || sum(CASE WHEN exported THEN 1 ELSE 0 END) OVER (PARTITION BY rec ORDER BY idx) END AS name FROM aud")
def w6(r: Recording) -> DataFrame:
    order = Window.partitionBy("rec").orderBy("idx")
    count = F.sum(F.col("exported").cast("int")).over(order)
    return r.audible.select("rec", "idx", F.when(F.col("idx") % 5 == 2, F.concat(F.lit("Song "), "idx")).when(F.col("exported"), F.concat(F.lit("Track "), count)).alias("name"))


@query("w7_export_numbers", "SELECT rec, idx, row_number() OVER (PARTITION BY rec ORDER BY idx) AS number, count(*) OVER (PARTITION BY rec) AS of FROM aud WHERE exported")
def w7(r: Recording) -> DataFrame:
    return r.plan.select("rec", "idx", "number", "of")


#: Final stems one after another: a title that an earlier final stem has, ASCII case aside, gets its number; not checked again.
FOLD_SQL = """, titled AS (SELECT rec, number, {title} AS title FROM (SELECT rec, idx, row_number() OVER (PARTITION BY rec ORDER BY idx) AS number, count(*) OVER (PARTITION BY rec) AS n FROM aud WHERE exported)),
named AS (SELECT rec, number, title AS stem, [lower(title)] AS done FROM titled WHERE number = 1 UNION ALL
  SELECT t.rec, t.number, CASE WHEN list_contains(d.done, lower(t.title)) THEN t.title || ' (' || t.number || ')' ELSE t.title END,
  list_append(d.done, lower(CASE WHEN list_contains(d.done, lower(t.title)) THEN t.title || ' (' || t.number || ')' ELSE t.title END)) FROM named d JOIN titled t ON t.rec = d.rec AND t.number = d.number + 1)
SELECT rec, number, stem FROM named"""


@query("w8_unique_stems", FOLD_SQL.format(title="CASE WHEN idx % 9 = 4 THEN 'SONG 1 (' || (number + 2) || ')' WHEN idx % 2 = 0 THEN 'song ' || idx % 7 ELSE 'Song ' || idx % 7 END"))
def w8(r: Recording) -> DataFrame:
    word = F.when(F.col("idx") % 2 == 0, "song ").otherwise("Song ")
    title = F.when(F.col("idx") % 9 == 4, F.concat(F.lit("SONG 1 ("), F.col("number") + 2, F.lit(")"))).otherwise(F.concat(word, F.col("idx") % 7))
    return segments.unique_stems(r.plan.select("rec", "number", title.alias("stem")))


@query("k1_export_plan", FOLD_SQL.format(title="CASE WHEN idx % 5 = 2 THEN 'AC_DC_ ' || idx % 2 ELSE 'Track ' || number END || ' - ' || lpad((number % 3 + 1)::VARCHAR, CAST(greatest(2, length(n::VARCHAR)) AS INTEGER), '0')"))
def k1_plan(r: Recording) -> DataFrame:
    """Numbering, names for untitled tracks, the template, safe names, and no name twice: the export plan in one."""
    titled = r.plan.select("rec", "idx", "number", "of", F.when(F.col("idx") % 5 == 2, F.concat(F.lit(" AC/DC: "), F.col("idx") % 2, F.lit(" "))).otherwise("").alias("title"))
    named = segments.export_plan(titled, "{title} - {nn}", F.lit("set"), number=F.col("number") % 3 + 1)
    return named.select("rec", "number", "stem")


@query("a5_split_counts", "SELECT rec, count(*) FILTER (confirmed) AS confirmed, count(*) FILTER (NOT confirmed) AS suggested FROM splitc GROUP BY rec")
def a5(r: Recording) -> DataFrame:
    return r.splits.groupBy("rec").agg(F.count_if("confirmed").alias("confirmed"), F.count_if(~F.col("confirmed")).alias("suggested"))


def probes(r: Recording, step: int = 97) -> DataFrame:
    return r.signal.filter(F.col("frame") % step == 0).select("rec", F.col("frame").alias("at_pos"))


PROBES = "probes AS (SELECT rec, unnest(range(0, total, 97)) AS at_pos FROM ends)"


def with_probes(sql: str) -> str:
    return f"{CTE}, {PROBES} {sql}"


@query("j5_next_and_previous", with_probes("SELECT p.rec, at_pos, (SELECT min(pos) FROM splits s WHERE s.rec = p.rec AND s.pos > at_pos) AS next, (SELECT max(pos) FROM splits s WHERE s.rec = p.rec AND s.pos < at_pos) AS previous FROM probes p"), cte=False)
def j5(r: Recording) -> DataFrame:
    """As-of in both directions by one ordered pass over splits and probes together, not a range join."""
    both = probes(r).select("rec", "at_pos", F.lit(True).alias("probe")).unionByName(r.splits.select("rec", F.col("pos").alias("at_pos"), F.lit(False).alias("probe")))
    split = F.when(~F.col("probe"), F.col("at_pos"))
    order = Window.partitionBy("rec").orderBy("at_pos")
    after = F.min(split).over(order.rangeBetween(1, Window.unboundedFollowing))
    before = F.max(split).over(order.rangeBetween(Window.unboundedPreceding, -1))
    return both.select("rec", "at_pos", "probe", after.alias("next"), before.alias("previous")).filter("probe").drop("probe")


@query("j6_nearest", with_probes("SELECT p.rec, at_pos, (SELECT pos FROM splits s WHERE s.rec = p.rec AND abs(s.pos - at_pos) <= 50 ORDER BY abs(s.pos - at_pos), pos LIMIT 1) AS nearest FROM probes p"), cte=False)
def j6(r: Recording) -> DataFrame:
    p = probes(r)
    found = segments.near(p, "at_pos", r.splits.select("rec", "pos"), "pos", 50)
    best = found.groupBy("rec", "at_pos").agg(F.min(F.struct(F.abs(F.col("pos") - F.col("at_pos")).alias("far"), "pos")).alias("m"))
    return p.join(best, ["rec", "at_pos"], "left").select("rec", "at_pos", F.col("m.pos").alias("nearest"))


@query("o5_top_one", "SELECT rec, win FROM (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY ss::DOUBLE / n, win) AS k FROM win) WHERE k = 1")
def o5(r: Recording) -> DataFrame:
    """The quietest window, the first of equal ones."""
    return r.windows.groupBy("rec").agg(F.min(F.struct((F.col("ss") / F.col("n")).alias("level"), "win")).alias("m")).select("rec", F.col("m.win").alias("win"))


@query("j7_silence_at", with_probes("SELECT p.rec, at_pos, s.start FROM probes p JOIN silences s ON s.rec = p.rec AND s.start <= at_pos AND at_pos < s.stop"), cte=False)
def j7(r: Recording) -> DataFrame:
    return segments.inside(probes(r), "at_pos", r.silences, "start", "stop").select("rec", "at_pos", "start")


@query("j1_keep_by_overlap", f"{CTE}, {OLD} SELECT s.rec, s.start, s.stop, EXISTS (SELECT 1 FROM old o WHERE o.rec = s.rec AND o.keep AND o.start < s.stop AND s.start < o.stop) AS keep FROM silences s", cte=False)
def j1(r: Recording) -> DataFrame:
    return segments.keep_by_overlap(r.silences.select("rec", "start", "stop"), old_silences(r))


@query("e4_set_silences", f"{CTE}, {OLD} SELECT n.rec, n.start, n.stop, (SELECT count(*) FROM silences o WHERE o.rec = n.rec AND o.keep AND greatest(o.start, n.start) < least(o.stop, n.stop)) > 0 AS keep FROM old n WHERE n.start < n.stop", cte=False)
def e4(r: Recording) -> DataFrame:
    """A new list in place of the present one, whose kept silences stay kept where they overlap."""
    return segments.keep_by_overlap(old_silences(r).filter("start < stop").select("rec", "start", "stop"), r.silences)


@query("j2_far_from_confirmed", "SELECT s.rec, s.pos FROM sug s WHERE NOT EXISTS (SELECT 1 FROM splitc c WHERE c.rec = s.rec AND c.confirmed AND abs(c.pos - s.pos) < 30)")
def j2(r: Recording) -> DataFrame:
    return segments.far(r.suggestions.select("rec", "pos"), r.splits.filter("confirmed"), 30)


#: Splits with titles on some.
TITLED = "titled AS (SELECT *, CASE WHEN idx % 2 = 1 THEN 'T' || pos ELSE '' END AS title FROM splitc)"


def titled(r: Recording) -> DataFrame:
    return r.splits.withColumn("title", F.when(F.col("idx") % 2 == 1, F.concat(F.lit("T"), "pos")).otherwise(""))


@query("j3_first_near_title", f"{CTE}, {TITLED} SELECT s.rec, s.pos, (SELECT arg_min(o.title, o.pos) FROM titled o WHERE o.rec = s.rec AND NOT o.confirmed AND o.title <> '' AND abs(o.pos - s.pos) < 70) AS title FROM sug s", cte=False)
def j3(r: Recording) -> DataFrame:
    """The title of the first suggestion near by that has one."""
    return segments.with_titles(r.suggestions.select("rec", "pos"), titled(r).filter("NOT confirmed"), 70)


@query("u1_redetect", "SELECT rec, pos, true AS confirmed FROM splitc WHERE confirmed UNION ALL SELECT s.rec, s.pos, false FROM sug s WHERE NOT EXISTS (SELECT 1 FROM splitc c WHERE c.rec = s.rec AND c.confirmed AND abs(c.pos - s.pos) < 30)")
def u1(r: Recording) -> DataFrame:
    return r.splits.filter("confirmed").select("rec", "pos", "confirmed").unionByName(j2(r).withColumn("confirmed", F.lit(False)))


@query("e5_apply_detection", f"{CTE}, {TITLED}, found AS (SELECT DISTINCT rec, pos + pos % 5 AS pos FROM sug) SELECT rec, pos, row_number() OVER (PARTITION BY rec ORDER BY pos) - 1 AS idx, confirmed, title FROM (SELECT rec, pos, confirmed, title FROM titled WHERE confirmed UNION ALL SELECT s.rec, s.pos, false, coalesce((SELECT arg_min(o.title, o.pos) FROM titled o WHERE o.rec = s.rec AND NOT o.confirmed AND o.title <> '' AND abs(o.pos - s.pos) < 30), '') FROM found s WHERE (SELECT coalesce(min(abs(c.pos - s.pos)), 30) FROM titled c WHERE c.rec = s.rec AND c.confirmed) >= 30)", cte=False)
def e5(r: Recording) -> DataFrame:
    return segments.redetected(titled(r), r.suggestions.select("rec", (F.col("pos") + F.col("pos") % 5).alias("pos")), 30)


@query("o2_upsert", "SELECT rec, pos, max(state) AS state FROM (SELECT rec, pos, 'a' AS state FROM splits UNION ALL SELECT rec, pos + (idx % 2) * 3, 'b' FROM splits) GROUP BY rec, pos")
def o2(r: Recording) -> DataFrame:
    rows = r.splits.select("rec", "pos", F.lit("a").alias("state")).unionByName(r.splits.select("rec", (F.col("pos") + F.col("idx") % 2 * 3).alias("pos"), F.lit("b").alias("state")))
    newest = Window.partitionBy("rec", "pos").orderBy(F.desc("state"))
    return rows.withColumn("k", F.row_number().over(newest)).filter("k = 1").drop("k")


@query("e1_insert", "SELECT rec, pos, idx FROM (SELECT rec, pos, row_number() OVER (PARTITION BY rec ORDER BY pos) - 1 AS idx, fresh FROM (SELECT rec, pos, max(fresh) AS fresh FROM (SELECT rec, pos, false AS fresh FROM splits UNION ALL SELECT rec, pos + (idx % 2) * 3, true FROM splits WHERE idx % 3 < 2) GROUP BY rec, pos)) WHERE fresh")
def e1(r: Recording) -> DataFrame:
    """Splits put into their places, one at the same place replaced: the index of each."""
    fresh = r.splits.filter("idx % 3 < 2").select("rec", (F.col("pos") + F.col("idx") % 2 * 3).alias("pos"), F.lit(True).alias("fresh"))
    both = r.splits.select("rec", "pos", F.lit(False).alias("fresh")).unionByName(fresh).groupBy("rec", "pos").agg(F.max("fresh").alias("fresh"))
    return both.withColumn("idx", (F.row_number().over(segments.by_pos()) - 1).cast("long")).filter("fresh").drop("fresh")


@query("w9_next_to_review", "SELECT a.rec, a.idx, coalesce((SELECT min(b.idx) FROM splitc b WHERE b.rec = a.rec AND NOT b.confirmed AND b.idx > a.idx), (SELECT min(b.idx) FROM splitc b WHERE b.rec = a.rec AND NOT b.confirmed)) AS next FROM splitc a")
def w9(r: Recording) -> DataFrame:
    order = Window.partitionBy("rec").orderBy("idx")
    open_idx = F.when(~F.col("confirmed"), F.col("idx"))
    return r.splits.select("rec", "idx", F.coalesce(F.min(open_idx).over(order.rowsBetween(1, Window.unboundedFollowing)), F.min(open_idx).over(Window.partitionBy("rec"))).alias("next"))


@query("w10_sliding_blocks", "SELECT rec, hop_idx, CAST(ss AS BIGINT) AS ss, CAST(n AS BIGINT) AS n FROM blocks")
def w10(r: Recording) -> DataFrame:
    return r.blocks


@query("j12_blocks_in_tracks", "SELECT rec, idx, count(*) AS n, min(hop_idx) AS first, max(hop_idx) AS last FROM inblock GROUP BY rec, idx")
def j12(r: Recording) -> DataFrame:
    return levels.blocks_in(r.blocks, r.exported, HOP).groupBy("rec", "idx").agg(F.count(F.lit(1)).alias("n"), F.min("hop_idx").alias("first"), F.max("hop_idx").alias("last"))


@query("j13_peak_in_tracks", f"SELECT t.rec, t.idx, max(h.peak) AS peak FROM tracks t JOIN hops h ON h.rec = t.rec AND h.hop_idx >= floor(t.start / {HOP}) AND h.hop_idx < ceil(t.stop / {HOP}) GROUP BY t.rec, t.idx")
def j13(r: Recording) -> DataFrame:
    return levels.range_peak(r.hops, r.tracks, HOP)


def gate_sql(keys: str, rows: str) -> str:
    return f"""SELECT {keys}, -0.691 + 10 * log10(avg(energy) FILTER (energy > g)) AS lufs FROM (
        SELECT *, greatest(avg(energy) FILTER (energy > {GATE}) OVER (PARTITION BY {keys}) * {SHARE}, {GATE}) AS g FROM {rows}) GROUP BY {keys}"""


def loud_sql(keys: str) -> str:
    """Loudness and peak of exported audio ranges, also of those without a block."""
    return f"""SELECT {keys}, lufs, 20 * log10(greatest(peak, 1e-10)) AS peak_db FROM (SELECT {keys}, max(peak) AS peak FROM inpeak GROUP BY {keys}) LEFT JOIN ({gate_sql(keys, "inblock")}) USING ({keys})"""


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 4) for n in names})


@query("a6_gated_loudness", f"SELECT rec, round(lufs, 4) AS lufs FROM ({gate_sql('rec', f'(SELECT rec, CAST(ss AS DOUBLE) / n / {FULL}e0 ** 2 AS energy FROM blocks)')})")
def a6(r: Recording) -> DataFrame:
    return levels.gated_mean(r.sounding[0], ["rec"], levels.ABSOLUTE, levels.RELATIVE).select("rec", F.round(levels.lufs(F.col("mean")), 4).alias("lufs"))


def track_loudness(r: Recording) -> DataFrame:
    return levels.loudness(*r.sounding, r.exported, HOP, ["rec", "idx"])


def album_loudness(r: Recording) -> DataFrame:
    return levels.loudness(*r.sounding, r.exported, HOP, ["rec"])


@query("a7_track_loudness", f"SELECT rec, idx, round(lufs, 4) AS lufs, round(peak_db, 4) AS peak_db FROM ({loud_sql('rec, idx')})")
def a7(r: Recording) -> DataFrame:
    return rounded(track_loudness(r), "lufs", "peak_db")


@query("a8_album_loudness", f"SELECT rec, round(lufs, 4) AS lufs, round(peak_db, 4) AS peak_db FROM ({loud_sql('rec')})")
def a8(r: Recording) -> DataFrame:
    return rounded(album_loudness(r), "lufs", "peak_db")


@query("a9_hop_energy", "SELECT rec, hop_idx, round(CAST(ss AS DOUBLE) / n, 4) AS energy, peak FROM hops")
def a9(r: Recording) -> DataFrame:
    return r.hops.select("rec", "hop_idx", F.round(F.col("ss") / F.col("n"), 4).alias("energy"), "peak")


#: The target is a loudness that brings some peaks to the ceiling.
TARGET = -14.0
GAIN_SQL = " UNION ALL ".join(
    f"""SELECT '{mode}' AS mode, rec, idx, round(g, 4) AS gain_db, round(-18 - lufs - g, 4) AS track_gain, round(CASE WHEN lufs IS NOT NULL THEN 10 ** ((peak_db + g) / 20) END, 4) AS track_peak,
    round({'NULL' if mode == 'track' else 'CASE WHEN lufs IS NOT NULL THEN -18 - al - g END'}, 4) AS album_gain, round({'NULL' if mode == 'track' else 'CASE WHEN lufs IS NOT NULL AND al IS NOT NULL THEN 10 ** ((ap + g) / 20) END'}, 4) AS album_peak
    FROM (SELECT *, CAST({gain} AS DOUBLE) AS g FROM loud JOIN (SELECT rec, lufs AS al, peak_db AS ap FROM album) USING (rec))"""
    for mode, gain in (("off", "0"), ("track", f"CASE WHEN lufs IS NULL THEN 0 ELSE least({TARGET} - lufs, -1 - peak_db) END"), ("album", f"CASE WHEN al IS NULL THEN 0 ELSE least({TARGET} - al, -1 - ap) END"))
)


@query("f7_replay_gain", f", loud AS ({loud_sql('rec, idx')}), album AS ({loud_sql('rec')}) {GAIN_SQL}")
def f7(r: Recording) -> DataFrame:
    each = track_loudness(r).withColumn("mode", F.explode(F.array(*[F.lit(m) for m in ("off", "track", "album")])))
    out = levels.job_gains(each, album_loudness(r), F.col("mode"), TARGET)
    return rounded(out, "gain_db", "track_gain", "track_peak", "album_gain", "album_peak")


@query("j14_snap", f"SELECT rec, pos, CAST(CASE WHEN here <= level THEN pos ELSE win * {WINDOW} + {WINDOW // 2} END AS BIGINT) AS snapped FROM (SELECT s.rec, s.pos, w.win, w.level, (SELECT level FROM lw o WHERE o.rec = s.rec AND o.win = s.own) AS here, row_number() OVER (PARTITION BY s.rec, s.pos ORDER BY w.level, abs(w.win - s.own), w.win) AS k FROM (SELECT s.rec, s.pos, least(s.pos // {WINDOW}, (SELECT max(win) FROM win x WHERE x.rec = s.rec)) AS own FROM splits s) s JOIN lw w ON w.rec = s.rec AND abs(w.win - s.own) <= 5) WHERE k = 1".replace("SELECT rec, pos, CAST", ", lw AS (SELECT rec, win, ss::DOUBLE / n AS level FROM win) SELECT rec, pos, CAST", 1))
def j14(r: Recording) -> DataFrame:
    return segments.snap(r.splits.select("rec", "pos"), r.windows, WINDOW, 5)


@query("j15_edge_silences", "SELECT s.rec, s.start, s.start = 0 OR s.stop >= total OR EXISTS (SELECT 1 FROM splits p WHERE p.rec = s.rec AND s.start < p.pos AND p.pos < s.stop) AS edge FROM silences s JOIN ends USING (rec)")
def j15(r: Recording) -> DataFrame:
    s = r.silences.join(r.ends, "rec").select("rec", "start", "stop", "total")
    inner = r.silences.select("rec", "start", (F.col("start") + 1).alias("lo"), F.col("stop").alias("hi"))
    hit = segments.inside(r.splits.select("rec", "pos"), "pos", inner).select("rec", "start").distinct().withColumn("hit", F.lit(True))
    return s.join(hit, ["rec", "start"], "left").select("rec", "start", ((F.col("start") == 0) | (F.col("stop") >= F.col("total")) | F.coalesce("hit", F.lit(False))).alias("edge"))


@query("j10_titles_by_place", "SELECT a.rec, a.idx, 'Title ' || t.k AS title FROM (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY idx) AS k FROM aud WHERE exported) a JOIN range(1, 9) t(k) USING (k)")
def j10(r: Recording) -> DataFrame:
    titles = r.spark.range(1, 9).select(F.col("id").alias("number"), F.concat(F.lit("Title "), "id").alias("title"))
    return r.plan.join(F.broadcast(titles), "number").select("rec", "idx", "title")


@query("a20_title_summary", "SELECT rec, count(*) AS kept, CASE WHEN count(*) = 8 THEN 'equal' WHEN count(*) < 8 THEN 'extra ignored' ELSE 'last keep titles' END AS summary FROM aud WHERE exported GROUP BY rec")
def a20(r: Recording) -> DataFrame:
    n = F.count(F.lit(1))
    return r.plan.groupBy("rec").agg(n.alias("kept"), F.when(n == 8, "equal").when(n < 8, "extra ignored").otherwise("last keep titles").alias("summary"))


@query("w14_first_difference", "SELECT a.rec, min(a.idx) AS first FROM splits a LEFT JOIN (SELECT rec, pos, row_number() OVER (PARTITION BY rec ORDER BY pos) - 1 AS idx FROM sug) b ON a.rec = b.rec AND a.idx = b.idx WHERE b.pos IS NULL OR a.pos <> b.pos GROUP BY a.rec")
def w14(r: Recording) -> DataFrame:
    other = r.suggestions.select("rec", F.col("pos").alias("other"), (F.row_number().over(segments.by_pos()) - 1).cast("long").alias("idx"))
    return r.splits.join(other, ["rec", "idx"], "left").filter("other IS NULL OR pos <> other").groupBy("rec").agg(F.min("idx").alias("first"))


@query("p3_points_in_view", "SELECT rec, pos FROM splits WHERE pos BETWEEN 100 AND 900")
def p3(r: Recording) -> DataFrame:
    return r.splits.filter(F.col("pos").between(100, 900)).select("rec", "pos")


@query("p4_tracks_in_view", "SELECT rec, idx FROM tracks WHERE stop > 100 AND start < 900")
def p4(r: Recording) -> DataFrame:
    return r.tracks.filter("stop > 100 AND start < 900").select("rec", "idx")


@query("p5_clip_to_view", "SELECT rec, idx, round((greatest(start, 100) - 100) * 100.0 / 800, 4) AS left_pct, round((least(stop, 900) - greatest(start, 100)) * 100.0 / 800, 4) AS width_pct FROM tracks WHERE stop > 100 AND start < 900")
def p5(r: Recording) -> DataFrame:
    a, b = F.greatest("start", F.lit(100)), F.least("stop", F.lit(900))
    return r.tracks.filter("stop > 100 AND start < 900").select("rec", "idx", F.round((a - 100) * 100.0 / 800, 4).alias("left_pct"), F.round((b - a) * 100.0 / 800, 4).alias("width_pct"))


@query("a13_planned_length", "SELECT rec, CAST(sum(audio_stop - audio_start) AS BIGINT) AS frames, round(sum(audio_stop - audio_start) / 4.0, 6) AS secs FROM aud WHERE exported GROUP BY rec")
def a13(r: Recording) -> DataFrame:
    n = F.sum(F.col("audio_stop") - F.col("audio_start"))
    return r.plan.groupBy("rec").agg(n.alias("frames"), F.round(n / 4.0, 6).alias("secs"))


@query("a18_snr", "SELECT rec, round(10 * log10(sum(cents * cents)::DOUBLE / greatest(sum(d * d)::DOUBLE, 1e-20)), 6) AS snr, CAST(max(abs(d)) AS BIGINT) AS worst FROM (SELECT *, cents % 7 - 3 AS d FROM signal) GROUP BY rec")
def a18(r: Recording) -> DataFrame:
    d = F.col("cents") % 7 - 3
    return r.signal.groupBy("rec").agg(F.round(10 * F.log10(F.sum(F.col("cents") * F.col("cents")) / F.greatest(F.sum(d * d).cast("double"), F.lit(1e-20))), 6).alias("snr"), F.max(F.abs(d)).alias("worst"))


@query("w13_resample", "SELECT rec, k, round(a * (1 - f) + b * f, 6) AS y FROM (SELECT s.rec, k, s.cents AS a, lead(s.cents, 1, s.cents) OVER (PARTITION BY s.rec, k % 1 ORDER BY s.frame) AS x, k * 0.75 - floor(k * 0.75) AS f, coalesce(n.cents, s.cents) AS b FROM (SELECT rec, unnest(range(0, CAST(floor(total / 0.75) AS BIGINT))) AS k FROM ends) g JOIN signal s ON s.rec = g.rec AND s.frame = CAST(floor(k * 0.75) AS BIGINT) LEFT JOIN signal n ON n.rec = s.rec AND n.frame = s.frame + 1)")
def w13(r: Recording) -> DataFrame:
    """Each output lies between an input frame and the next: a frame makes the one or two outputs that begin at it."""
    order = Window.partitionBy("rec").orderBy("frame")
    pair = r.signal.join(r.ends, "rec").select("rec", "total", "frame", F.col("cents").alias("a"), F.coalesce(F.lead("cents").over(order), F.col("cents")).alias("b"))
    first = lambda f: F.floor((4 * f + 2) / 3)
    made = pair.withColumn("k", F.explode(F.sequence(first(F.col("frame")), first(F.col("frame") + 1) - 1))).filter(F.col("k") < F.floor(F.col("total") / 0.75))
    f = F.col("k") * 0.75 - F.col("frame")
    return made.select("rec", "k", F.round(F.col("a") * (1 - f) + F.col("b") * f, 6).alias("y"))


@query("w18_drift", "SELECT rec, frame FROM (SELECT *, lag(d) OVER (PARTITION BY rec ORDER BY frame) AS p FROM (SELECT rec, frame, cents % 40 - 20 AS d FROM signal)) WHERE abs(d - p) <= 3 AND abs(d) > 6")
def w18(r: Recording) -> DataFrame:
    d = r.signal.select("rec", "frame", (F.col("cents") % 40 - 20).alias("d"))
    return d.withColumn("p", F.lag("d").over(Window.partitionBy("rec").orderBy("frame"))).filter("abs(d - p) <= 3 AND abs(d) > 6").select("rec", "frame")


@query("s8_silence", "SELECT range AS frame, CAST(0 AS BIGINT) AS cents FROM range(1000)", cte=False)
def s8(r: Recording) -> DataFrame:
    return source.silence(r.spark, 1000)


@query("s9_range_source", "SELECT g.rec, g.frame, CAST(coalesce(s.cents, 0) AS BIGINT) AS cents FROM (SELECT rec, f.range AS frame FROM ends, range(120) f) g LEFT JOIN signal s ON s.rec = g.rec AND s.frame = g.frame - 20")
def s9(r: Recording) -> DataFrame:
    return source.in_range(r.spark, r.signal, 20, 100)


@query("e8_nudge", "SELECT rec, pos, greatest(1, least(total - 1, pos - 200)) AS moved FROM splits JOIN ends USING (rec)")
def e8(r: Recording) -> DataFrame:
    return r.splits.join(r.ends, "rec").select("rec", "pos", F.greatest(F.lit(1).cast("long"), F.least(F.col("total") - 1, F.col("pos") - 200)).alias("moved"))


@query("f36_focus_track", with_probes("SELECT p.rec, at_pos, (SELECT count(*) FROM splits s WHERE s.rec = p.rec AND s.pos <= at_pos) AS track FROM probes p"), cte=False)
def f36(r: Recording) -> DataFrame:
    both = probes(r).select("rec", "at_pos", F.lit(0).alias("split")).unionByName(r.splits.select("rec", F.col("pos").alias("at_pos"), F.lit(1).alias("split")))
    upto = Window.partitionBy("rec").orderBy("at_pos").rangeBetween(Window.unboundedPreceding, 0)
    return both.withColumn("track", F.sum("split").over(upto)).filter("split = 0").select("rec", "at_pos", "track")
