"""Labels, flags, statuses, settings, the view and their table rules against hand-computed cases."""

import pytest
from pyspark.sql import functions as F

from wavespan.functions import states as S

L = F.lit
none = lambda kind: L(None).cast(kind)
ACTIONS = lambda *a: F.array(*map(L, a))
CASES = [
    (lambda: S.flac_depth(L(24)), 24), (lambda: S.flac_depth(L(16)), 16), (lambda: S.flac_depth(none("int")), 16),
    (lambda: S.profile_label(L("mp3_vbr"), L(2)), "MP3 VBR V2 (~190 kbps)"), (lambda: S.profile_label(L("mp3_cbr"), L(320)), "MP3 CBR 320 kbps"), (lambda: S.profile_label(L("other"), L(1)), None),
    (lambda: S.profile_short(L("mp3_vbr"), L(0)), "MP3 V0"), (lambda: S.profile_short(L("mp3_cbr"), L(128)), "MP3 128k"), (lambda: S.profile_short(L("wav16"), none("int")), "WAV 16"),
    (lambda: S.video_label(L(18)), "MP4 · high quality"), (lambda: S.video_label(L(23)), "MP4 · standard"), (lambda: S.video_label(L(24)), "MP4 · small files"),
    (lambda: S.loudness_label(L("off"), none("int")), "Loudness unchanged"), (lambda: S.loudness_label(L("track"), L(-16)), "Each track to -16 LUFS"),
    (lambda: S.flag(none("string")), False), (lambda: S.flag(L(" ")), False), (lambda: S.flag(L(" NO ")), False), (lambda: S.flag(L("0")), False), (lambda: S.flag(L("off")), True), (lambda: S.flag(L("00")), True),
    (lambda: S.may_send(L("e"), L(False), L(True), L(False)), True), (lambda: S.may_send(L("e"), L(False), none("boolean"), L(False)), False), (lambda: S.may_send(L("e"), L(False), none("boolean"), L(True)), True), (lambda: S.may_send(L("e"), L(False), L(False), L(True)), False),
    (lambda: S.may_send(L("e"), L(True), L(True), L(True)), False), (lambda: S.may_send(none("string"), L(False), L(True), L(True)), False), (lambda: S.may_send(L("e"), L(False), none("boolean"), L(True), default=False), False),
    (lambda: S.accepted_title(L("  "), L(" Roxy "), L(True)), "Roxy"), (lambda: S.accepted_title(L("  "), L("Roxy"), L(False)), ""), (lambda: S.accepted_title(L(" Song "), L("Roxy"), L(True)), "Song"),
    (lambda: S.source_facts(L("unknown"), L(0), L(1_000_000), L(60.0)), (133, True)), (lambda: S.source_facts(L("none"), L(0), L(1000), L(0.0)), (8, True)), (lambda: S.source_facts(L("pcm"), L(1411), L(1), L(1.0)), (1411, False)),
    (lambda: S.bitrate_label(L("vbr"), L(190), L(32), L(320)), "VBR 32–320 kbps (avg 190)"), (lambda: S.bitrate_label(L("avg"), L(190), L(0), L(0)), "~190 kbps"), (lambda: S.bitrate_label(L("none"), L(0), L(0), L(0)), ""),
    (lambda: S.chips(L("a"), L(""), L(0), L(0), L(3.0), L(262_144 * 4321), L(True)), ["a", "0:03", "1080.2 MB"]), (lambda: S.chips(L("a"), L(""), L(0), L(0), L(3.0), L(262_144), L(True)), ["a", "0:03", "0.2 MB"]), (lambda: S.chips(L("a"), L(""), L(0), L(0), L(3.0), L(786_432), L(True)), ["a", "0:03", "0.8 MB"]), (lambda: S.chips(L("a"), L(""), L(0), L(0), L(3.0), L(262_145), L(True)), ["a", "0:03", "0.3 MB"]), (lambda: S.chips(L("a"), L(""), L(0), L(0), L(3.0), L(1_048_575), L(True)), ["a", "0:03", "1.0 MB"]),
    (lambda: S.chips(L("MP3"), L("CBR 128 kbps"), L(44100), L(6), L(125.0), L(2_097_152), L(False)), ["MP3", "CBR 128 kbps", "44.1 kHz", "6 ch", "2:05", "2.0 MB"]), (lambda: S.chips(L("H.264"), L(""), L(0), L(0), L(3.0), L(1_048_576), L(True)), ["H.264", "0:03", "1.0 MB"]),
    (lambda: S.export_fraction(L("running"), L(2), L(4), L(0.5)), 0.625), (lambda: S.export_fraction(L("running"), L(0), L(0), L(0.0)), 0.0), (lambda: S.export_fraction(L("queued"), L(2), L(4), L(0.5)), None),
    (lambda: S.is_active(L("queued")), True), (lambda: S.is_active(L("failed")), False), (lambda: S.is_active(none("string")), False),
    (lambda: S.status_after_all(L("Todo"), ACTIONS("select")), "InProgress"), (lambda: S.status_after_all(L("Done"), ACTIONS("select")), "Done"), (lambda: S.status_after_all(L("Todo"), ACTIONS("flag", "flag")), "InProgress"), (lambda: S.status_after_all(L("Todo"), ACTIONS("select", "finish", "exported")), "Exported"), (lambda: S.status_after_all(L("Flagged"), ACTIONS("select", "zoom")), "Flagged"),
    (lambda: S.detect_settings(L(-8.0), L(1.5), L("louder")), (-6.0, 1.5)), (lambda: S.detect_settings(L(-45.0), L(1.5), L("quieter")), (-48.0, 1.5)), (lambda: S.detect_settings(L(-45.0), L(0.4), L("shorter")), (-45.0, 0.25)), (lambda: S.detect_settings(L(-45.0), L(1.5), L("longer")), (-45.0, 1.75)),
    (lambda: S.detection_step(L(False), L(True)), "detect and tag"), (lambda: S.detection_step(L(True), L(False)), "tag"), (lambda: S.detection_step(L(True), L(True)), "nothing"),
    (lambda: S.revealed(L(100), L(50), L(1000), L(149), False), 100), (lambda: S.revealed(L(100), L(50), L(1000), L(150), False), 145), (lambda: S.revealed(L(100), L(50), L(1000), L(120), True), 95), (lambda: S.revealed(L(100), L(50), L(1000), L(999), False), 950), (lambda: S.revealed(L(100), L(50), L(20), L(3), False), 0),
    (lambda: S.scrolled(L(100), L(50), L(1000), L(-200)), 0), (lambda: S.scrolled(L(100), L(50), L(1000), L(2000)), 950), (lambda: S.scrolled(L(100), L(50), L(1000), L(7)), 107),
    (lambda: S.followed(L(100), L(100), L(1000), L(196)), 100), (lambda: S.followed(L(100), L(100), L(1000), L(197)), 194), (lambda: S.followed(L(100), L(100), L(1000), L(2)), 0),
    (lambda: S.zoomed(L(0), L(20.0), L(60_000), L(1000), L(10_000), L(0.5)), (5000, 10.0)), (lambda: S.zoomed(L(0), L(20.0), L(60_000), L(1000), L(0), L(0.5)), (0, 10.0)), (lambda: S.zoomed(L(10_000), L(20.0), L(60_000), L(1000), L(59_000), L(2.0)), (0, 40.0)), (lambda: S.zoomed(L(0), L(20.0), L(60_000), L(1000), L(0), L(9.0)), (0, 60.0)), (lambda: S.zoomed(L(0), L(2.0), L(60_000), L(1000), L(0), L(0.1)), (0, 2.0)),
]


@pytest.fixture(scope="module")
def found(spark):
    row = spark.range(1).select(*[make().alias(f"c{k}") for k, (make, _) in enumerate(CASES)]).first()
    return [tuple(v) if hasattr(v, "asDict") else v for v in row]


@pytest.mark.parametrize("k", range(len(CASES)))
def test_case(found, k):
    assert found[k] == CASES[k][1]


def test_toggled(spark):
    tracks = spark.createDataFrame([("a", 0, False), ("a", 1, True), ("b", 0, False)], "rec string, idx long, dropped boolean")
    presses = spark.createDataFrame([("a", 0), ("a", 1), ("a", 1), ("a", 9), ("c", 0)], "rec string, idx long")
    assert sorted(map(tuple, S.toggled(tracks, presses).collect())) == [("a", 0, True), ("a", 1, True), ("b", 0, False)]


def test_next_batch(spark):
    lines = [("big", 0, "x" * 5000), ("big", 1, "y"), *[("many", k, "z") for k in range(300)], ("ex", 0, "a" * 1999), ("ex", 1, "b" * 1999), ("ex", 2, "")]
    got = S.next_batch(spark.createDataFrame(lines, "queue string, seq long, line string")).groupBy("queue").agg(F.count("seq"), F.max("seq"))
    assert {r[0]: (r[1], r[2]) for r in got.collect()} == {"big": (1, 0), "many": (200, 199), "ex": (2, 1)}
    assert S.next_batch(spark.createDataFrame([], "queue string, seq long, line string")).count() == 0


def test_sidebar(spark):
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    recordings = table([(c,) for c in "abcdefgh"], "rec string")
    edits = table([("a", 2, 0), ("b", 2, 1), ("c", 0, 0), ("d", 5, 0)], "rec string, confirmed long, open long")
    scans = table([(c, "ready", 1.0, 125.0) for c in "abcdh"] + [("e", "scanning", 0.999, 0.0), ("f", "failed", 0.0, 0.0)], "rec string, scan string, progress double, secs double")
    exports = table([("d", "running", 1, 6), ("a", "finished", 6, 6), ("f", "failed", 0, 1)], "rec string, export string, done long, of long")
    got = dict(map(tuple, S.sidebar(recordings, edits, scans, exports).collect()))
    assert got == {"a": "3 tracks ✓", "b": "1 to review", "c": "2:05", "d": "exporting 1/6", "e": "99%", "f": "export failed", "g": "…", "h": "2:05"}


def test_orders(spark, tmp_path):
    from wavespan.functions import state_queries as Q

    names = ["b", "A", "a", "C", "\u00c4"]
    spark.createDataFrame(list(enumerate(names)), "c_custkey long, c_name string").write.parquet(f"{tmp_path}/customer.parquet")
    got = [r[0] for r in Q.queries()["o1_sort_names"](spark, str(tmp_path)).collect()]
    assert [names[k] for k in got] == ["A", "a", "b", "C", "\u00c4"]
    spark.range(60).select(F.col("id").alias("event_id")).write.parquet(f"{tmp_path}/events.parquet")
    rows = Q.queries()["o3_version_sort"](spark, str(tmp_path)).collect()
    keys = [(*map(int, r["version"].split(".")), -r["event_id"]) for r in rows]
    assert keys == sorted(keys, reverse=True) and len(keys) == 60
    assert keys[0][:2] == (2, 11)  # by numbers; as text 2.9 would come first
