"""Hand-computed cases of the segment and level operators."""

import pytest
from pyspark.sql import functions as F

from wavespan.operators import levels, segments


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def pattern(spark, parts, window=50, rate=20):
    """(seconds, dB) parts as 20 windows a second."""
    db = [v for secs, v in parts for _ in range(int(secs * rate))]
    flags = table(spark, [("r", k, v < -45) for k, v in enumerate(db)], "rec string, win long, quiet boolean")
    return flags, table(spark, [("r", len(db) * window)], "rec string, total long")


def suggested(spark, parts):
    flags, ends = pattern(spark, parts)
    runs = segments.runs(flags, 30 if min(p[0] for p in parts) > 1 else 20)
    return [(r.pos, r.len) for r in segments.thin(segments.suggest(runs, ends, 50), 30_000).orderBy("pos").collect()]


def test_middle_of_gap(spark):
    assert suggested(spark, [(60, -20), (2, -70), (60, -20)]) == [(61_000, 2000)]


def test_ends_are_not_suggested(spark):
    assert suggested(spark, [(3, -80), (60, -20), (3, -80)]) == []


def test_longer_of_close_suggestions(spark):
    assert suggested(spark, [(60, -20), (2, -70), (10, -20), (4, -70), (60, -20)]) == [(74_000, 4000)]


def test_tags(spark):
    flags, ends = pattern(spark, [(3, -80), (60, -20), (2, -70), (60, -20), (3, -80)])
    got = segments.tag(segments.runs(flags, 30), ends, 50, 250).orderBy("start").collect()
    assert [(r.start, r.stop) for r in got] == [(0, 2750), (63_250, 64_750), (125_250, 128_000)]


def test_tracks_cover_and_edges_are_cut(spark):
    ends = table(spark, [("r", 100)], "rec string, total long")
    tracks = segments.tracks(table(spark, [("r", 50)], "rec string, pos long"), ends)
    silences = table(spark, [("r", 0, 5), ("r", 20, 25), ("r", 45, 55), ("r", 90, 100)], "rec string, start long, stop long")
    got = segments.audible(tracks, silences).orderBy("idx").collect()
    assert [(r.audio_start, r.audio_stop) for r in got] == [(5, 45), (55, 90)]


def test_union_complement_rebase(spark):
    ends = table(spark, [("r", 150)], "rec string, total long")
    cut = table(spark, [("r", 0, 5), ("r", 45, 55), ("r", 95, 105), ("r", 50, 100), ("r", 140, 150)], "rec string, start long, stop long")
    merged = segments.merge(cut)
    assert [(r.start, r.stop) for r in merged.orderBy("start").collect()] == [(0, 5), (45, 105), (140, 150)]
    kept = segments.rebase(segments.complement(merged, ends)).orderBy("start").collect()
    assert [(r.start, r.stop, r.out_start) for r in kept] == [(5, 45, 0), (105, 140, 40)]


def test_gates(spark):
    rows = [("r", 10.0)] * 50 + [("r", 0.001)] * 30 + [("r", 2.0)] * 20 + [("q", 0.001)]
    got = {r.rec: r["mean"] for r in levels.gated_mean(table(spark, rows, "rec string, energy double"), ["rec"], 0.01, 0.5).collect()}
    assert got == {"r": 10.0, "q": None}


def audible(spark, splits, silences, total, dropped=()):
    ends = table(spark, [("r", total)], "rec string, total long")
    tracks = segments.tracks(table(spark, [("r", p) for p in splits], "rec string, pos long"), ends)
    own = segments.audible(tracks, table(spark, [("r", *s) for s in silences], "rec string, start long, stop long"))
    return own.withColumn("exported", (F.col("audio_stop") > F.col("audio_start")) & ~F.col("idx").isin(*dropped))


def spans(df):
    return [(r.start, r.stop) for r in df.orderBy("start").collect()]


def test_silence_inside_a_track_stays(spark):
    silences = [(0, 5), (20, 30), (45, 55), (95, 105), (120, 125)]
    assert spans(segments.left_out(audible(spark, [50, 100], silences, 150))) == [(0, 5), (45, 55), (95, 105)]
    assert spans(segments.left_out(audible(spark, [50, 100], silences, 150, [1]))) == [(0, 5), (45, 105)]
    kept = audible(spark, [50, 100], silences, 150, [1]).filter("exported").select("rec", "idx", F.col("audio_start").alias("start"), F.col("audio_stop").alias("stop"))
    assert [(r.start, r.stop, r.out_start) for r in segments.rebase(kept).orderBy("start").collect()] == [(5, 45, 0), (105, 150, 40)]


def test_splits_beyond_the_end_count_as_at_it(spark):
    ends = table(spark, [("r", 100)], "rec string, total long")
    got = segments.tracks(table(spark, [("r", 60), ("r", 400)], "rec string, pos long"), ends)
    assert spans(got) == [(0, 60), (60, 100), (100, 100)]


def test_silent_track_is_left_out(spark):
    own = audible(spark, [100, 150, 250], [(90, 160)], 400)
    assert [(r.audio_start, r.audio_stop) for r in own.filter("exported").orderBy("idx").collect()] == [(0, 90), (160, 250), (250, 400)]


def test_redetection_carries_titles(spark):
    splits = table(spark, [("r", 1000, False, "Kept"), ("r", 800, True, "")], "rec string, pos long, confirmed boolean, title string")
    got = segments.redetected(splits, table(spark, [("r", 1050), ("r", 5000), ("r", 850)], "rec string, pos long"), 100)
    assert [(r.pos, r.confirmed, r.title) for r in got.orderBy("idx").collect()] == [(800, True, ""), (1050, False, "Kept"), (5000, False, "")]


def test_snap_compares_levels(spark):
    rows = [("r", k, 100 if k != 110 else 1, 1) for k in range(200)] + [("r", 200, 50, 2)]
    wins = table(spark, rows, "rec string, win long, ss long, n long")
    at = lambda pos: segments.snap(table(spark, [("r", pos)], "rec string, pos long"), wins, 50, 10).first().snapped
    assert (at(5000), at(2500), at(9_990), at(99_999)) == (5525, 2500, 10_025, 99_999)


def test_names_are_made_unique_once(spark):
    rows = [("r", 1, "Jam"), ("r", 2, "JAM"), ("r", 3, "jam (2)"), ("r", 4, "É"), ("r", 5, "é")]
    got = segments.unique_stems(table(spark, rows, "rec string, number long, stem string")).orderBy("number").collect()
    assert [r.stem for r in got] == ["Jam", "JAM (2)", "jam (2) (3)", "É", "é"]
    plan = segments.export_plan(table(spark, [("r", k + 1, 3, t) for k, t in enumerate(["Intro", "AC/DC: Live?", ""])], "rec string, number long, of long, title string"), "{nn} - {title}", F.lit("x"))
    assert [r.stem for r in plan.orderBy("number").collect()] == ["01 - Intro", "02 - AC_DC_ Live_", "03 - Track 3"]


def energy(lufs):
    return 10 ** ((lufs + 0.691) / 10)


def test_loudness_of_ranges(spark):
    parts = [(40, -30), (40, -10), (30, -120), (20, -34)]
    hops = [energy(v) for n, v in parts for _ in range(n)]
    blocks = table(spark, [("r", k, v) for k, v in enumerate(hops)], "rec string, hop_idx long, energy double")
    peaks = table(spark, [("r", k, 10 ** (-3 / 20)) for k in range(len(hops))], "rec string, hop_idx long, peak double")
    ranges = table(spark, [("r", 0, 40 * 10 + 3, 800), ("r", 1, 800, 1100), ("r", 2, 0, 30)], "rec string, idx long, start long, stop long")
    got = {r.idx: r for r in levels.loudness(blocks, peaks, ranges, 10, ["rec", "idx"]).collect()}
    assert got[0].lufs == pytest.approx(-10) and got[1].lufs is None and got[2].lufs is None and got[2].peak_db == pytest.approx(-3)


def test_gains(spark):
    tracks = table(spark, [("r", 0, -20.0, -3.0), ("r", 1, None, -90.0)], "rec string, idx long, lufs double, peak_db double")
    albums = table(spark, [("r", -19.0, -3.0)], "rec string, lufs double, peak_db double")
    gain = lambda *how: {r.idx: r for r in levels.job_gains(tracks, albums, *how).collect()}
    up, down, album, off, copied = gain("track", -14.0), gain("track", -21.0), gain("album", -21.0), gain("off", -14.0), gain("album", -21.0, False)
    assert up[0].gain_db == pytest.approx(2) and down[0].gain_db == pytest.approx(-1) and up[0].album_gain is None
    assert up[0].track_gain == pytest.approx(0) and up[0].track_peak == pytest.approx(10 ** (-1 / 20))
    assert album[0].gain_db == pytest.approx(-2) and album[0].track_gain == pytest.approx(4) and album[0].album_gain == pytest.approx(3)
    assert off[0].gain_db == copied[0].gain_db == 0 and off[0].album_gain == pytest.approx(1) and off[1].track_gain is None
