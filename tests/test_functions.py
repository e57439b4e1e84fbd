"""Column functions against hand-computed cases."""

import pytest
from pyspark.sql import functions as F

from wavespan.functions import numbers as N
from wavespan.functions import texts as T

L = F.lit
HEX = "ab" * 32
FACTS = lambda **k: {n: L(v) for n, v in ({"lossy": True, "copyable": True, "kbps": 128, "rate": 44100, "channels": 2, "bits": None} | k).items()} | ({"bits": L(k.get("bits")).cast("int")})
CASES = [
    (lambda: T.clock_precise(L(3723.4567)), "1:02:03.457"), (lambda: T.clock_precise(L(-1.0)), "00:00.000"), (lambda: T.clock_precise(L(59.9996)), "01:00.000"),
    (lambda: T.clock_short(L(3723.4567)), "1:02:03"), (lambda: T.clock_short(L(123.9994)), "2:03"), (lambda: T.clock_short(L(123.9996)), "2:04"), (lambda: T.clock_short(L(None).cast("double")), None),
    (lambda: T.size_label(L(1_234_000_000)), "1.2 GB"), (lambda: T.size_label(L(2_400_000)), "2 MB"), (lambda: T.size_label(L(500)), "1 kB"),
    (lambda: T.sanitize(L(' .a/b:c\t"d". ')), "a_b_c__d_"), (lambda: T.sanitize(L(" .. ")), "untitled"), (lambda: F.length(T.sanitize(L("x" * 300))), 180),
    (lambda: T.track_stem(L("{nn} {title}"), L(7), L(123), L("by {source}"), L("set")), "007 by set"), (lambda: T.track_stem(L("{n}-{nn}"), L(7), L(9), L("t"), L("s")), "7-07"),
    (lambda: T.renamed(L("/a/b.mp3"), L("c:d")), "/a/c_d.mp3"), (lambda: T.renamed(L("/a/b.mp3"), L("b")), None),
    (lambda: T.clean_title(L("1. Title")), "Title"), (lambda: T.clean_title(L("[00:03:12] Title (4:32)")), "Title"), (lambda: T.clean_title(L("1984 Song")), "1984 Song"), (lambda: T.clean_title(L("99 Problems")), "Problems"),
    (lambda: T.clean_title(L("03:12 – 02) A [4:32] -")), "A [4:32]"), (lambda: T.clean_title(L("#3 • B 4:32")), "B"), (lambda: T.clean_title(L("3rd Song")), "3rd Song"), (lambda: T.clean_title(L("(7) x")), "x"), (lambda: T.clean_title(L("3:12")), ""),
    (lambda: T.titles(L("1 A\n\n2 B\r\n - ")), ["A", "B"]), (lambda: T.is_time(L("1:02:03")), True), (lambda: T.is_time(L("1:2:3:4")), False), (lambda: T.is_time(L("100:00")), False),
    (lambda: T.newer(L("v1.10.0-beta.1"), L("1.9.9")), True), (lambda: T.newer(L("1.2"), L("1.0.0")), False), (lambda: T.newer(L("1.2.3+x"), L("1.2.3")), False),
    (lambda: T.clean_version(L("1.0-a")), "1.0-a"), (lambda: T.clean_version(L("1.0 <x>")), "unknown"), (lambda: T.clean_version(L("1" * 21)), "unknown"),
    (lambda: T.byte_range(L("bytes=10-"), L(100)), (10, 99)), (lambda: T.byte_range(L("bytes=-30, 5-6"), L(100)), (70, 99)), (lambda: T.byte_range(L("bytes=5-200"), L(100)), (5, 99)), (lambda: T.byte_range(L(None).cast("string"), L(100)), (0, 99)),
    (lambda: T.byte_range(L("bytes=100-"), L(100)), None), (lambda: T.byte_range(L("bytes=-0"), L(100)), None), (lambda: T.byte_range(L("items=1-2"), L(100)), None), (lambda: T.byte_range(L("bytes=7-3"), L(100)), None), (lambda: T.byte_range(L("bytes=-"), L(100)), None),
    (lambda: T.progress(L("P finished"), "P"), ("converting", None)), (lambda: T.progress(L("P at 30 NA 60"), "P"), ("downloading", 0.5)), (lambda: T.progress(L("P at 90 60"), "P"), ("downloading", 1.0)), (lambda: T.progress(L("P at x"), "P"), ("downloading", None)), (lambda: T.progress(L("Q at 1 2"), "P"), None),
    (lambda: T.error_kind(L("ERROR: Private video. Sign in to confirm")), "private"), (lambda: T.error_kind(L("HTTP Error 403: Forbidden")), "refused"), (lambda: T.error_kind(L("other")), None),
    (lambda: T.hex_word(L(f"x {HEX.upper()}  f {HEX[:-1]}c")), HEX), (lambda: T.hex_word(L(HEX + "a")), None), (lambda: T.manifest_hash(L("11  a\n22  b \n33  b"), L("b")), "22"),
    (lambda: T.concat_filter(F.array(F.struct(L(1.0).alias("start"), L(2.5).alias("stop"))), False), "[0:v:0]split=1[sv0];[sv0]trim=start=1.000000:end=2.500000,setpts=PTS-STARTPTS[v0];[v0]concat=n=1:v=1:a=0[v]"),
    (lambda: T.utc_label(L(951_782_400)), "2000-02-29T00:00:00Z"), (lambda: T.utc_label(L(-1)), "1969-12-31T23:59:59Z"),
    (lambda: T.utc_label(L(253_402_300_799)), "9999-12-31T23:59:59Z"), (lambda: T.utc_label(L(253_402_300_800)), "10000-01-01T00:00:00Z"), (lambda: T.utc_label(L(6_000_000 * 86_399)), "18397-04-02T13:20:00Z"),
    (lambda: T.wave_path(F.array(F.struct(L(-1.0).alias("lo"), L(1.0).alias("hi")), F.struct(L(0.0).alias("lo"), L(0.5).alias("hi")))), "M0,0.70L1,25.20L1,50.30L0,99.30Z"),
    (lambda: T.path_token(L("/x/ab.c?d")), "ab"), (lambda: T.path_token(L("ab?q=1")), "ab"), (lambda: T.media_kind(L("/x/a.MP3")), "audio"), (lambda: T.media_kind(L("a.mov")), "video"), (lambda: T.media_kind(L("mp3")), None),
    (lambda: F.round(N.loudness(N.energy(L(-14.0))), 9), -14.0), (lambda: N.decibels(L(0.0)), -200.0), (lambda: F.round(N.amplitude(L(-6.0)), 6), 0.501187), (lambda: N.normalise_gain(L(-20.0), L(-3.0), -14.0), 2.0), (lambda: N.normalise_gain(L(None).cast("double"), L(-3.0), -14.0), 0.0),
    (lambda: N.quantise(L(2.5 / 32768), 16), 3), (lambda: N.quantise(L(-2.5 / 32768), 16), -3), (lambda: N.quantise(L(1.0), 16), 32767), (lambda: N.quantise(L(-2.0), 24), -(1 << 23)), (lambda: N.vbr_kbps(L(12)), 65), (lambda: N.vbr_kbps(L(0)), 245),
    (lambda: N.estimate_bytes(L("mp3_vbr"), L(2), FACTS(), L(10.0)), 237500), (lambda: N.estimate_bytes(L("original"), L(0), FACTS(copyable=False, bits=24), L(1.0)), 153468), (lambda: N.estimate_bytes(L("wav16"), L(0), FACTS(), L(1.0)), 176400),
    (lambda: N.warnings(L("mp3_cbr"), L(320), FACTS(rate=96000)), ["encoded again", "bitrate above source", "resampled"]), (lambda: N.warnings(L("original"), L(0), FACTS(copyable=False)), ["not copyable"]), (lambda: N.warnings(L("wav16"), L(0), FACTS(lossy=False, bits=24)), ["fewer bits"]),
    (lambda: N.rescale(L(2**62), L(90_000), L(1), L(48_000)), 2**62 * 15 // 8), (lambda: N.tick_step(L(11.0)), 2.0), (lambda: N.tick_step(L(1e5)), 1200.0), (lambda: N.ticks(L(0.5), L(10.0)), [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 9.0, 10.0]), (lambda: N.view_window(L(95), L(100), L(12)), (88, 100)), (lambda: N.view_window(L(5), L(9), L(12)), (0, 9)),
    (lambda: N.pixel_frame(L(200.0), L(50.0), L(300.0), L(1000), L(48_000)), 25_000), (lambda: N.cut_plan(L(0), L(11_520), L(1152), L(100)), (0, 10, False, 0, 529)), (lambda: N.cut_plan(L(5000), L(20_000), L(1152), L(100)), (2, 16, True, 3319, 1265)), (lambda: N.cut_plan(L(5), L(5), L(1152), L(9)), None),
    (lambda: N.cut_plan(L(10_368), L(20_000), L(1152), L(9)), None), (lambda: N.cut_fields(L(11_520), L(20_000), L(1152), L(9)), (8, 1, True, 2927, 0)), (lambda: N.cut_fields(L(5000), L(20_000), L(1152), L(100)), (2, 16, True, 3319, 1265)),
    (lambda: N.frame_header(L(0xFFFB9064)), (1, 44100, 128, 2, 417, 1152, 32)), (lambda: N.frame_header(L(0xFFFB92C4)), (1, 44100, 128, 1, 418, 1152, 17)), (lambda: N.frame_header(L(0xFFF38064)), (2, 22050, 64, 2, 208, 576, 17)), (lambda: N.frame_header(L(0xFFFBF064)), None), (lambda: N.frame_header(L(0xFFFD9064)), None), (lambda: N.frame_header(L(0xFFE390C4)), (25, 11025, 80, 1, 522, 576, 9)),
]


@pytest.fixture(scope="module")
def found(spark):
    row = spark.range(1).select(*[make().alias(f"c{k}") for k, (make, _) in enumerate(CASES)]).first()
    return [tuple(v) if hasattr(v, "asDict") else v for v in row]


@pytest.mark.parametrize("k", range(len(CASES)))
def test_case(found, k):
    assert found[k] == CASES[k][1]


def test_cleaned_names(spark):
    table = lambda *names: spark.createDataFrame([(n,) for n in names], "path string")
    got = T.cleaned_names(table("/a/x.mp3", "/a/y.mov", "/a/z"), table("/a/x (cleaned).wav", "/a/x (cleaned 3).wav", "/a/y (cleaned).wav", "/a/z (cleaned 2).wav", "/a/q.wav"))
    assert dict(map(tuple, got.collect())) == {"/a/x.mp3": "/a/x (cleaned 2).wav", "/a/y.mov": "/a/y (cleaned).mp4", "/a/z": "/a/z (cleaned).wav"}
