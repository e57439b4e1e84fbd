"""File sources and sinks: round trips, brute force and hand-made bytes."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavespan.functions import numbers
from wavespan.operators import commands, kweighting
from wavespan.sinks import tags, tracks
from wavespan.sinks import texts as text_sinks
from wavespan.sources import files, mp3, mp4, wav
from wavespan.sources import texts as documents


def mpeg(seed: int, count: int) -> tuple[bytes, list]:
    """Frames of random rates and audio data, each with a place that its data begin."""
    rng = np.random.default_rng(seed)
    out, seen = b"ID3\x03\0\0\0\0\0\x05hello" + b"\0\xff\x00", []
    for k in range(count):
        head = bytes([0xFF, 0xFB, int(rng.integers(1, 6)) << 4, 0x64])
        h = mp3.header(head)
        back = int(rng.integers(0, 512)) if k else 0
        body = bytes([back >> 1, (back & 1) << 7]) + rng.integers(0, 255, h.length - 6).astype(np.uint8).tobytes()
        seen.append((len(out), h.length, back, h.length - 36))
        out += head + body
    return out + b"TAG" + bytes(125), seen


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    return tmp_path_factory.mktemp("files")


def test_header_agrees_with_columns(spark):
    words = [0xFFE00000 | b << 8 & 0x1F0000 | (w & 0xFFFF) for b in range(0, 0x2000, 0x100) for w in range(0, 0x10000, 0x3C0)]
    rows = spark.createDataFrame([(w,) for w in words], "w long").select("w", numbers.frame_header(F.col("w")).alias("h")).collect()
    for w, h in rows:
        own = mp3.header(w.to_bytes(4, "big"))
        assert (own is None) == (h is None)
        assert own is None or (own.version, own.rate, own.kbps, own.channels, own.length, own.samples, own.side) == tuple(h)


def test_mpeg_index_starts_and_cut(spark, folder):
    data, seen = mpeg(3, 60)
    (folder / "a.mp3").write_bytes(data)
    (folder / "b.mp3").write_bytes(b"no frames at all")
    found = mp3.index(spark.createDataFrame([(str(folder / n),) for n in ("a.mp3", "b.mp3")], "path string")).cache()
    rows = sorted(found.collect(), key=lambda r: r.frame)
    assert [(r.start, r.length, r.back, r.main) for r in rows] == seen

    def begins(j):
        need, i = seen[j][2], j
        while need > 0 and i > 0:
            i -= 1
            need -= seen[i][3]
        return i

    starts = {r.frame: r.decode_from for r in mp3.decode_starts(found).collect()}
    assert starts == {k: min([max(k - 2, 0), *[begins(j) for j in range(max(k - 2, 0), k + 1)]]) for k in range(60)}
    assert mp3.summary(found).select("frames", "total", "vbr", "audio_end").first()[:] == (60, 60 * 1152, True, len(data) - 128)
    jobs = spark.createDataFrame([("original", str(folder / "a.mp3"), str(folder / f"out/{n}.mp3"), a, b) for n, a, b in (("x", 0, 9000), ("y", 30_000, 50_000), ("z", 9, 9))], "profile string, path string, target string, start long, stop long")
    ready = mp3.index(spark.createDataFrame([(str(folder / "a.mp3"),)], "path string"))
    cuts = tracks.mp3_cuts(jobs, ready).select("target", "profile", "path", "cut", F.lit(None).cast("array<struct<start:long,stop:long>>").alias("ranges"), F.struct(F.lit("T").alias("title")).alias("tags"))
    done = {r.target.rsplit("/", 1)[1]: (r.bytes, r.error) for r in tracks.export(cuts).collect()}
    assert done["z.mp3"] == (None, "empty track") and done["x.mp3"][1] is None and done["y.mp3"][1] is None
    assert sorted(p.name for p in (folder / "out").iterdir()) == ["x.mp3", "y.mp3"]
    for name, first, last, carrier in (("x.mp3", 0, 8, 0), ("y.mp3", 24, 44, 1)):
        got = (folder / "out" / name).read_bytes()
        own = list(mp3.frames(mp3.Blocks(__import__("pyarrow").BufferReader(got))))
        assert len(own) == last - first + carrier  # the frame of tables counts as none
        assert got.endswith(data[seen[first][0] : seen[last][0]])
        at = got.index(b"Xing")
        frames, size = struct.unpack_from(">II", got, at + 8)
        assert frames == len(own) and size == len(got) - len(tags.id3v2("T"))
        assert struct.unpack_from(">H", got, at + 154)[0] == tags.crc16(got[at - 36 : at + 154])
        if carrier:
            before = b"".join(data[s + n - m : s + n] for s, n, _, m in seen[:first])[-511:]
            assert before in got[own[0][0] : own[1][0]]


def test_wav_round_trip(spark, folder):
    rng = np.random.default_rng(1)
    layouts = []
    for bits, form in ((8, 1), (16, 1), (24, 1), (32, 1), (32, 3)):
        raw = rng.normal(0, 0.2, (777, 2)).astype("<f4").tobytes() if form == 3 else rng.integers(0, 255, 777 * 2 * bits // 8).astype(np.uint8).tobytes()
        fmt = struct.pack("<HHIIHH", form, 2, 8000, 8000 * bits // 4, bits // 4, bits)
        path = folder / f"w{bits}_{form}.wav"
        path.write_bytes(tracks.wav_head(fmt, len(raw)).replace(b"data", b"LIST\x03\0\0\0abc\0data") + raw)
        layouts.append((str(path), bits, form, raw))
    (folder / "broken.wav").write_bytes(b"RIFFxxxx")
    found = wav.layouts(files.recordings(spark, str(folder)).filter("path LIKE '%.wav'"))
    by = {r.path.rsplit("/", 1)[1]: r for r in found.collect()}
    assert by["broken.wav"].error == "not a RIFF/WAVE file" and by["w24_1.wav"].frames == 777
    got = wav.samples(found, 100).toPandas().sort_values(["path", "frame", "channel"])
    for path, bits, form, raw in layouts:
        x = got[got.path.str.endswith(path.rsplit("/", 1)[1])].value.to_numpy()
        if form == 3:
            want = np.frombuffer(raw, "<f4").astype(float)
        elif bits == 8:
            want = (np.frombuffer(raw, np.uint8) - 128.0) / 128
        else:
            step = bits // 8
            want = np.array([int.from_bytes(raw[k : k + step], "little", signed=True) for k in range(0, len(raw), step)]) / 2.0 ** (bits - 1)
        assert np.array_equal(x, want)


def test_weighted_tone(spark, folder):
    t = np.arange(48_000 * 3) / 48_000
    x = np.sin(2 * np.pi * 997 * t)
    (folder / "tone").mkdir()
    (folder / "tone/t.wav").write_bytes(tracks.wav_head(struct.pack("<HHIIHH", 3, 1, 48_000, 384_000, 8, 64), 8 * len(x)) + x.astype("<f8").tobytes())
    layouts = wav.layouts(files.recordings(spark, str(folder / "tone")))
    whole, parts = (kweighting.hop_energy(layouts, size).toPandas().sort_values("hop") for size in (1 << 22, 30_001))
    assert np.allclose(whole.energy, parts.energy, rtol=1e-9) and np.allclose(whole.peak, parts.peak)
    assert abs(-0.691 + 10 * np.log10(whole.energy.iloc[-1]) + 3.01) < 0.02
    assert len(whole) == 30 and 0.99 < whole.peak.iloc[10] < 1.02


def box(kind: bytes, *bodies: bytes) -> bytes:
    return struct.pack(">I4s", 8 + sum(map(len, bodies)), kind) + b"".join(bodies)


def track(handler: bytes, edits: bytes = b"") -> bytes:
    return box(b"trak", edits, box(b"mdia", box(b"mdhd", bytes(12) + struct.pack(">I", 48_000)), box(b"hdlr", bytes(8) + handler)))


def test_movies(spark, folder):
    head = box(b"mvhd", bytes(12) + struct.pack(">II", 1000, 2500))
    listed = box(b"edts", box(b"elst", struct.pack(">IIIiIIiI", 0, 2, 9, -1, 0, 9, 1024, 0)))
    some = {"silent.mp4": box(b"mdat", bytes(99)) + box(b"moov", head, track(b"vide")), "sound.mp4": box(b"moov", head, track(b"vide"), track(b"soun", listed)), "junk.mp4": b"abc"}
    for name, data in some.items():
        (folder / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[1]: r[1:] for r in mp4.movies(spark.createDataFrame([(str(folder / n),) for n in some], "path string")).collect()}
    assert got == {"silent.mp4": (2.5, None), "sound.mp4": (None, 1024 / 48_000), "junk.mp4": (None, None)}


def test_tags():
    assert tags.crc16(b"123456789") == 0xBB3D
    assert tags.id3v2("é", track=2, total=9)[10:25] == b"TIT2\0\0\0\5\0\0\1\xff\xfe\xe9\0" and tags.id3v2() == b"ID3\x03" + bytes(6)
    assert tags.vorbis_comment("a", track=1, total=2, vendor="v") == b"\1\0\0\0v\3\0\0\0\7\0\0\0TITLE=a\x0d\0\0\0TRACKNUMBER=1\x0c\0\0\0TRACKTOTAL=2"


def test_documents(spark, folder):
    end = 2**64 - 1
    doc = {"version": 1, "recordings": {"a.mp3": {"status": "done", "detected": True, "splits": [{"at": 5, "state": "Confirmed", "title": "x", "drop": False}, {"at": end, "state": "Suggested"}], "silences": []}}}
    (folder / "cut.json").write_text(json.dumps(doc))
    found = documents.documents(spark, str(folder / "cut.json"), documents.CUTLIST)
    ends = spark.createDataFrame([("a.mp3", 100)], "rec string, total long")
    assert sorted(r[:3] for r in documents.splits_of(found, ends).collect()) == [("a.mp3", 5, "Confirmed"), ("a.mp3", 100, "Suggested")]
    (folder / "bad.json").write_text("{")
    with pytest.raises(Exception, match="(?i)malformed"):
        documents.documents(spark, str(folder / "bad.json"), documents.CUTLIST).collect()
    text_sinks.save_document(found.select("doc.version"), str(folder / "new.json"), str(folder / "bad.json"))
    assert json.loads((folder / "new.json").read_text()) == {"version": 1} and not (folder / "bad.json").exists()
    text_sinks.rewrite_lines(iter(['{"t": 1000, "e": "old"}', "", "junk", '{"t": 900000, "e": "new"}']), str(folder / "q.jsonl"))
    assert [r.e for r in documents.queue(spark, str(folder / "q.jsonl"), "t long, e string", 1_000_000).collect()] == ["new"]
    text_sinks.rewrite_lines(iter([]), str(folder / "q.jsonl"))
    assert not (folder / "q.jsonl").exists()


def test_change_log(spark):
    log = ["# Log", "- before", "## [Unreleased]", "- a", "## [1.2.0] - 2020-01-02", "### Added", "- b", "  goes on", "", "- c", "### Fixed", "- d  ", "---", "- footer"]
    lines = spark.createDataFrame([("p", k, x) for k, x in enumerate(log)], "path string, n int, line string")
    got = documents.changes(lines)
    want = [("Unreleased", "", "a"), ("1.2.0", "Added", "b goes on"), ("1.2.0", "Added", "c"), ("1.2.0", "Fixed", "d")]
    assert [(r.version, r.heading, r.item) for r in got.orderBy("place").collect()] == want
    feed = text_sinks.release_feed(got).first().releases
    assert [(r.version, [(s.heading, s["items"]) for s in r.sections]) for r in feed] == [("Unreleased", [("", ["a"])]), ("1.2.0", [("Added", ["b goes on", "c"]), ("Fixed", ["d"])])]


def test_commands():
    edit = commands.Edit([(10, "Suggested", "", False), (20, "Suggested", "", False), (30, "Confirmed", "", False)], 100)
    assert edit.apply("confirm_and_next", 0, 0) == 1 and edit.apply("confirm_and_next", 1, 0) == 2
    assert edit.apply("move", 0, 30) == 1 and [s[0] for s in edit.splits] == [20, 30]
    assert edit.apply("undo", None, None) == 0 and [s[0] for s in edit.splits] == [10, 20, 30]
    assert edit.apply("redo", None, None) == 0 and [s[0] for s in edit.splits] == [20, 30]
    assert edit.apply("add", None, 100) is None and edit.apply("add", None, 25) == 1 and edit.apply("next", None, 25) == 2
    assert edit.apply("delete_and_next", 0, 0) is None and edit.apply("redo", None, None) is None
    for k in range(600):
        edit.apply("add", None, 1 + k % 99)
    assert len(edit.past) <= commands.DEPTH
