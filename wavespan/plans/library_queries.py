"""A library of files, edits and queues: made by rule from the tables, written to the shared folder and read again.

Each query runs the operator over files or rows whose content follows from a table's keys, so that its SQL can say
from the keys alone what must come out.
"""

from __future__ import annotations

import json
import struct

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wavespan.functions import texts
from wavespan.operators import commands
from wavespan.plans.file_queries import SAMPLE, _folder, _rec, _written
from wavespan.plans.recording import Recording
from wavespan.plans.recording_queries import CTE
from wavespan.sinks import tags, tracks
from wavespan.sinks import texts as text_sinks
from wavespan.sources import files, mp3, mp4, wav
from wavespan.sources import texts as documents

REGISTRY: dict[str, tuple] = {}


def query(sql: str):
    def register(f):
        REGISTRY[f.__name__] = (f, sql)
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nations(spark: SparkSession, sf_dir: str) -> list[tuple[int, str, int]]:
    """The 25 nations, from which files are made."""
    return [tuple(r) for r in table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey").orderBy("n_nationkey").collect()]


def put(path: str, data: bytes) -> None:
    tracks.write(path, iter([data]))


def name_of(path: str = "path") -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


# ---- files of a folder -----------------------------------------------------------------------

ENDINGS = [".mp3", ".WAV", ".txt", ".Mp4", ".flac"]
_ENDING = "['.mp3', '.WAV', '.txt', '.Mp4', '.flac'][n_nationkey % 5 + 1]"
_KIND = "CASE n_nationkey % 5 WHEN 3 THEN 'video' ELSE 'audio' END"


def _library(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark, "library")
    for k, name, _ in nations(spark, sf_dir):
        put(f"{folder}/{'._' * (k % 7 == 6)}{name.lower() if k % 2 else name}{ENDINGS[k % 5]}", bytes(k + 1))
        put(f"{folder}/deeper/{name}.mp3", b"not right in the folder")
    return files.recordings(spark, folder)


_LIBRARY = f"SELECT n_nationkey AS k, CASE WHEN n_nationkey % 2 = 1 THEN lower(n_name) ELSE n_name END || {_ENDING} AS name, n_nationkey + 1 AS length, {_KIND} AS kind FROM nation WHERE n_nationkey % 5 IN (0, 1, 3) AND n_nationkey % 7 <> 6"


@query(f"SELECT name, length, kind, row_number() OVER (ORDER BY lower(name), name) AS place FROM ({_LIBRARY})")
def s1_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.orderBy(F.lower("name"), "name")  # a folder's listing
    return _library(spark, sf_dir).select(name_of().alias("name"), "length", "kind").withColumn("place", F.row_number().over(order).cast("long"))


def _scans(found: DataFrame) -> DataFrame:
    """Scans of some files: of a third none, of a third one of another length."""
    return found.filter("length % 3 > 0").select("path", F.when(F.col("length") % 3 == 1, F.col("length")).otherwise(F.col("length") + 1).alias("length"), "modified")


@query(f"SELECT name FROM ({_LIBRARY}) WHERE length % 3 <> 1")
def s14_stale_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _library(spark, sf_dir)
    return files.stale(found, _scans(found)).select(name_of().alias("name"))


@query(f"SELECT name FROM ({_LIBRARY}) WHERE length % 3 = 0 OR length % 4 = 1")
def p7_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings without a scan that is ready."""
    found = _library(spark, sf_dir)
    states = found.filter("length % 3 > 0").select("path", F.when(F.col("length") % 4 == 1, "Running").otherwise("Ready").alias("state"))
    return found.join(states.filter("state = 'Ready'"), "path", "left_anti").select(name_of().alias("name"))


@query(f"SELECT name, CASE WHEN length % 3 > 0 THEN length * 10 END AS splits FROM ({_LIBRARY})")
def j8_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings with what their edits say, where they have one."""
    found = _library(spark, sf_dir)
    edits = found.filter("length % 3 > 0").select(name_of().alias("name"), (F.col("length") * 10).alias("splits"))
    return found.select(name_of().alias("name")).join(edits, "name", "left")


@query(f"SELECT greatest(180.0, least(900.0, max(length(name)) * 7.2 + 150))::DOUBLE AS width FROM ({_LIBRARY})")
def a16_longest_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    longest = F.coalesce(F.max(F.length(name_of())), F.lit(20))
    return _library(spark, sf_dir).agg(F.greatest(F.lit(180.0), F.least(F.lit(900.0), longest * 7.2 + 150)).alias("width"))


@query("SELECT k, substring(text, k * 10 + 1, 25) AS content FROM (SELECT string_agg(n_name, '/' ORDER BY n_nationkey) AS text FROM nation), range(5) r(k)")
def s10_byte_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{_folder(spark, 'slices')}/all.txt"
    put(path, "/".join(n for _, n, _ in nations(spark, sf_dir)).encode())
    parts = spark.range(5).select(F.lit(path).alias("path"), (F.col("id") * 10).alias("start"), (F.col("id") * 10 + 25).alias("stop"))
    runs = files.slices(parts, 7).groupBy("start").agg(F.sort_array(F.collect_list(F.struct("at", "content"))).alias("runs"))
    return runs.select((F.col("start") / 10).cast("long").alias("k"), F.concat_ws("", F.transform("runs", lambda r: r["content"].cast("string"))).alias("content"))


# ---- MPEG files ------------------------------------------------------------------------------

#: Frame k of the made file has 32 * (1 + k % 5) kbps at 44,100 Hz, a padding byte every third, and reaches back k * 37 % 300 bytes.
FRAMES = 200
_FRAMES = f"f AS (SELECT k, CASE WHEN k % 5 < 4 THEN 32 + k % 5 * 8 ELSE 64 END AS kbps, k * 37 % 300 AS back FROM range({FRAMES}) r(k)), g AS (SELECT *, 144000 * kbps // 44100 + CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END AS length FROM f), h AS (SELECT *, CAST(sum(length) OVER (ORDER BY k) - length + 15 AS BIGINT) AS start, length - 36 AS main, CAST(sum(length - 36) OVER (ORDER BY k) - (length - 36) AS BIGINT) AS bytes FROM g)"


def _mpeg(spark: SparkSession) -> DataFrame:
    data = b"ID3\x03\0\0\0\0\0\x05hello"
    for k in range(FRAMES):
        head = bytes([0xFF, 0xFB, (1 + k % 5) << 4 | 2 * (k % 3 == 0), 0x64])
        back = k * 37 % 300
        length = 144_000 * (32 + k % 5 * 8 if k % 5 < 4 else 64) // 44_100 + (k % 3 == 0)
        data += head + bytes([back >> 1, (back & 1) << 7]) + bytes([k % 251] * (length - 6))
    path = f"{_folder(spark, 'mpeg')}/made.mp3"
    put(path, data + b"TAG" + bytes(125))
    return files.recordings(spark, path.rsplit("/", 1)[0])


@query(f"WITH {_FRAMES} SELECT k AS frame, start, length, kbps, back, main FROM h")
def s2_mpeg_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mp3.index(_mpeg(spark)).select("frame", "start", "length", "kbps", "back", "main")


@query(f"WITH {_FRAMES}, b AS (SELECT j.k, (SELECT coalesce(max(i.k), 0) FROM h i WHERE i.k <= j.k AND i.bytes <= j.bytes - j.back) AS begins FROM h j) SELECT a.k AS frame, least(greatest(a.k - 2, 0), min(b.begins)) AS decode_from FROM h a JOIN b ON b.k BETWEEN a.k - 2 AND a.k GROUP BY a.k")
def s6_decode_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mp3.decode_starts(mp3.index(_mpeg(spark))).select("frame", "decode_from")


@query(f"WITH {_FRAMES} SELECT min(kbps) AS least, max(kbps) AS most, CAST(sum(kbps) AS BIGINT) // count(*) AS mean, min(kbps) <> max(kbps) AS vbr, count(*) AS frames FROM h")
def a10_bitrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mp3.summary(mp3.index(_mpeg(spark))).select("least", "most", "mean", "vbr", "frames")


@query(f"WITH {_FRAMES} SELECT CAST(round(sum(length) * 8 / 1000.0 / (count(*) * 1152 / 44100.0)) AS BIGINT) AS kbps FROM h")
def a11_packet_kbps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mp3.packet_kbps(mp3.index(_mpeg(spark))).select("kbps")


#: Ranges of samples that are cut out of the made file.
CUTS = ((0, 9000), (30_000, 50_000), (100_000, 999_999), (5, 5))


@query(f"""WITH {_FRAMES}, c AS (SELECT * FROM (VALUES {', '.join(f'({k}, {a}, {b})' for k, (a, b) in enumerate(CUTS))}) v(cut, a, b)),
p AS (SELECT cut, greatest(a // 1152 - 2, 0) AS first, least(CAST(ceil(b / 1152) AS BIGINT), {FRAMES}) AS last FROM c WHERE b > a)
SELECT cut, last - first AS copied, first > 0 AS carrier, (SELECT CAST(sum(length) AS BIGINT) FROM h WHERE k >= first AND k < last) AS bytes, (SELECT kbps FROM h WHERE k = first) AS first_kbps FROM p""")
def k4_mpeg_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cuts written as files and indexed again: the copied frames, and whether a carrier frame goes before them."""
    source, target = _mpeg(spark), _folder(spark, "mpeg-cuts")
    wanted = F.array(*[F.struct(F.lit(k).alias("cut"), F.lit(a).cast("long").alias("start"), F.lit(b).cast("long").alias("stop")) for k, (a, b) in enumerate(CUTS)])
    jobs = source.select("path", F.explode(wanted).alias("w")).select("path", F.lit("original").alias("profile"), F.concat(F.lit(f"{target}/"), F.col("w.cut"), F.lit(".mp3")).alias("target"), "w.start", "w.stop", F.lit(None).cast("array<struct<start:long,stop:long>>").alias("ranges"), F.struct(F.lit("T").alias("title")).alias("tags"))
    tracks.export(tracks.mp3_cuts(jobs, mp3.index(source))).write.parquet(f"{target}-done")
    again = mp3.index(files.recordings(spark, target)).withColumn("cut", F.regexp_extract("path", r"(\d+)\.mp3", 1).cast("int"))
    plain = F.col("kbps") <= 64  # the carrier holds 511 bytes, which no made frame does
    return again.groupBy("cut").agg(F.count_if(plain).alias("copied"), (F.count_if(~plain) > 0).alias("carrier"), F.sum(F.when(plain, F.col("length"))).alias("bytes"), F.min_by(F.when(plain, F.col("kbps")), F.when(plain, F.col("frame"))).alias("first_kbps"))


# ---- WAV files -------------------------------------------------------------------------------


@query(CTE + f"SELECT rec, frame, {SAMPLE} AS sample FROM signal WHERE frame >= 35 AND frame < 90")
def s5_pcm_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wav.samples(_written(spark, sf_dir), 20, 35, 90).select(_rec(), "frame", F.round(F.col("value") * 32768).cast("long").alias("sample"))


def _exported(spark: SparkSession, sf_dir: str, profile: str, ranges: tuple, gain: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(done, samples of the files written)."""
    target = _folder(spark, "tracks")
    spans = F.array(*[F.struct(F.lit(a).cast("long").alias("start"), F.lit(b).cast("long").alias("stop")) for a, b in ranges])
    jobs = _written(spark, sf_dir).select(F.concat(F.lit(f"{target}/"), _rec(), F.lit(".wav")).alias("target"), F.lit(profile).alias("profile"), "path", spans.alias("ranges"), F.lit(gain).alias("gain"), F.struct("*").alias("layout"))
    tracks.export(jobs).write.parquet(f"{target}-done")
    done = spark.read.schema("target string, bytes long, error string").parquet(f"{target}-done")
    return done, wav.layouts(files.recordings(spark, target)) if not done.filter("bytes IS NOT NULL").isEmpty() else None


def _heard(layouts: DataFrame) -> DataFrame:
    return wav.samples(layouts).select(_rec(), "frame", F.round(F.col("value") * 32768).cast("long").alias("sample"))


_WAVES = f"w AS (SELECT rec, frame, {SAMPLE} AS sample FROM signal)"


@query(CTE + f", {_WAVES} SELECT rec, frame - 40 AS frame, sample FROM w WHERE frame >= 40")
def k2_wav_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range that goes on beyond the end, drawn in to it."""
    return _heard(_exported(spark, sf_dir, "original", ((40, 1 << 40),))[1])


@query(CTE + f", {_WAVES} SELECT rec, frame - 10 AS frame, CAST(least(greatest(round(sample * 10 ** (-6 / 20e0)), -32768), 32767) AS BIGINT) AS sample FROM w WHERE frame >= 10 AND frame < 70")
def k7_wav16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _heard(_exported(spark, sf_dir, "wav16", ((10, 70),), -6.0)[1])


@query(CTE + f", {_WAVES} SELECT rec, frame, sample FROM w")
def k8_whole_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _heard(_exported(spark, sf_dir, "wav16", ((0, 1 << 40),))[1])


@query(CTE + "SELECT rec || '.wav' AS name, CASE WHEN total > 60 THEN 44 + 2 * (least(total, 100) - 60) END AS bytes, CASE WHEN total <= 60 THEN 'empty track' END AS error FROM ends UNION ALL SELECT rec || '.wav', NULL, 'empty track' FROM ends UNION ALL SELECT rec || '.wav', NULL, 'can''t be copied' FROM ends")
def k1_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of jobs: files written whole, and errors that leave nothing behind."""
    good = _exported(spark, sf_dir, "original", ((60, 100),))[0].unionByName(_exported(spark, sf_dir, "wav16", ((50, 50),))[0])
    jobs = _written(spark, sf_dir).select(F.concat(F.lit(f"{_folder(spark, 'none')}/"), _rec(), F.lit(".wav")).alias("target"), F.lit("original").alias("profile"), "path", F.array().cast("array<struct<start:long,stop:long>>").alias("ranges"))
    return good.unionByName(tracks.export(jobs)).select(name_of("target").alias("name"), "bytes", "error")


# ---- movies, tags, checksums -----------------------------------------------------------------


def _box(kind: bytes, *bodies: bytes) -> bytes:
    return struct.pack(">I4s", 8 + sum(map(len, bodies)), kind) + b"".join(bodies)


def _movies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each nation a movie: every third with a sound track, whose edits begin with an empty one."""
    folder = _folder(spark, "movies")
    for k, _, _ in nations(spark, sf_dir):
        def track(handler: bytes, *edits: bytes) -> bytes:
            return _box(b"trak", *edits, _box(b"mdia", _box(b"mdhd", bytes(12) + struct.pack(">I", 44_100)), _box(b"hdlr", bytes(8) + handler)))

        listed = _box(b"edts", _box(b"elst", struct.pack(">IIIiIIiI", 0, 2, 9, -1, 0, 9, 1000 + k, 0)))
        head = _box(b"mvhd", bytes(12) + struct.pack(">II", 600, 600 + 7 * k)) if k % 2 else _box(b"mvhd", b"\1" + bytes(19) + struct.pack(">IQ", 600, 600 + 7 * k))
        put(f"{folder}/{k}.mp4", _box(b"mdat", bytes(k)) + _box(b"moov", head, track(b"vide"), *[track(b"soun", listed)] * (k % 3 == 0)))
    return mp4.movies(files.recordings(spark, folder)).withColumn("k", F.regexp_extract("path", r"(\d+)\.mp4", 1).cast("int"))


@query("SELECT n_nationkey AS k, round((600 + 7 * n_nationkey) / 600.0, 9) AS secs FROM nation WHERE n_nationkey % 3 > 0")
def s11_silent_video(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _movies(spark, sf_dir).filter("silent_seconds IS NOT NULL").select("k", F.round("silent_seconds", 9).alias("secs"))


@query("SELECT n_nationkey AS k, round((1000 + n_nationkey) / 44100.0, 9) AS secs FROM nation WHERE n_nationkey % 3 = 0")
def s12_priming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _movies(spark, sf_dir).filter("priming_seconds IS NOT NULL").select("k", F.round("priming_seconds", 9).alias("secs"))


@query(CTE + "SELECT s.rec, s.pos, s.pos + CASE WHEN s.idx % 2 = 0 THEN 0 ELSE 1024 END AS moved FROM splits s")
def e13_priming_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splits of movies moved by their sound's priming; recordings without any stay."""
    r = Recording(spark, sf_dir)
    shifts = spark.createDataFrame([(0, None), (1, 1024 / 48_000)], "part long, priming_seconds double")
    own = r.splits.select("rec", "pos", (F.col("idx") % 2).alias("part")).join(F.broadcast(shifts), "part")
    return own.select("rec", "pos", (F.col("pos") + F.coalesce(F.round(F.col("priming_seconds") * 48_000), F.lit(0)).cast("long")).alias("moved"))


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return tags.blocks(n.select(F.col("n_nationkey").alias("key"), F.when(F.col("n_nationkey") % 4 > 0, F.col("n_name")).alias("title"), F.lit("Al").alias("album"), (F.col("n_nationkey") % 3).alias("track"), F.lit(9).alias("total")))


_TITLE = "CASE WHEN n_nationkey % 4 > 0 THEN n_name ELSE '' END"


def _id3_frame(name: str, text: str) -> str:
    return f"CASE WHEN {text} = '' THEN '' ELSE '{name.encode().hex().upper()}' || printf('%08X', 3 + 2 * length({text})) || '000001FFFE' || regexp_replace(hex({text}), '(..)', '\\1' || '00', 'g') END"


_ID3 = " || ".join([_id3_frame("TIT2", _TITLE), _id3_frame("TALB", "'Al'"), _id3_frame("TRCK", "CASE WHEN n_nationkey % 3 > 0 THEN (n_nationkey % 3) || '/9' ELSE '' END")])


@query(f"SELECT key, '49443303000000' || printf('%06X', length(body) // 2 // 128 * 256 + length(body) // 2 % 128) || body AS id3 FROM (SELECT n_nationkey AS key, {_ID3} AS body FROM nation)")
def k5_id3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tagged(spark, sf_dir).select("key", F.hex("id3").alias("id3"))


def _comment(text: str) -> str:
    return f"printf('%02X000000', length({text})) || hex({text})"


@query(f"""SELECT n_nationkey AS key, {_comment("'wavespan'")} || printf('%02X000000', 1 + CASE WHEN n_nationkey % 4 > 0 THEN 1 ELSE 0 END + CASE WHEN n_nationkey % 3 > 0 THEN 2 ELSE 0 END)
|| CASE WHEN n_nationkey % 4 > 0 THEN {_comment("'TITLE=' || n_name")} ELSE '' END || {_comment("'ALBUM=Al'")} || CASE WHEN n_nationkey % 3 > 0 THEN {_comment("'TRACKNUMBER=' || (n_nationkey % 3)")} || {_comment("'TRACKTOTAL=9'")} ELSE '' END AS vorbis FROM nation""")
def k6_vorbis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tagged(spark, sf_dir).select("key", F.hex("vorbis").alias("vorbis"))


@query(f"""WITH RECURSIVE t AS (SELECT n_nationkey AS key, {_TITLE} AS s FROM nation), c AS (SELECT key, s, 0 AS k, 0 AS bit, 0::INTEGER AS crc FROM t UNION ALL
SELECT key, s, CASE WHEN bit = 8 THEN k + 1 ELSE k END, CASE WHEN bit = 8 THEN 0 ELSE bit + 1 END, CASE WHEN bit = 0 THEN xor(crc, ascii(s[k + 1])) WHEN crc & 1 = 1 THEN xor(crc >> 1, 40961) ELSE crc >> 1 END FROM (SELECT key, s, k, CASE WHEN bit = 9 THEN 0 ELSE bit END AS bit, crc FROM c) WHERE k < length(s)),
n AS (SELECT key, arg_max(crc, k * 10 + bit) AS crc FROM c GROUP BY key) SELECT key, crc AS checksum FROM n""")
def a17_crc16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tagged(spark, sf_dir).select("key", "checksum")


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def a17_sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text"), 256).alias("digest"))


# ---- edit documents, queues, feeds -----------------------------------------------------------


def _document(spark: SparkSession, sf_dir: str) -> str:
    """A saved edit document: a recording for each nation, whose last split lies at the end that no number reaches."""
    edits = {name: {"status": ["New", "Done", "Edited"][k % 3], "detected": k % 2 == 0, "splits": [{"at": 10 * j, "state": "Confirmed" if j % 2 else "Suggested", "title": f"{name} {j}", "drop": j == 2} for j in range(1, 1 + k % 4)] + [{"at": 2**64 - 1, "state": "Suggested", "title": "", "drop": False}], "silences": []} for k, name, _ in nations(spark, sf_dir)}
    folder = _folder(spark, "edits")
    put(f"{folder}/old.json", json.dumps({"version": 1, "recordings": edits}).encode())
    text_sinks.save_document(documents.documents(spark, f"{folder}/old.json", documents.CUTLIST).select("doc.*"), f"{folder}/new.json", f"{folder}/old.json")
    return folder


def _edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.documents(spark, _document(spark, sf_dir), documents.CUTLIST)


_SPLITS = "SELECT n_name AS rec, j * 10 AS pos, CASE WHEN j % 2 = 1 THEN 'Confirmed' ELSE 'Suggested' END AS state, n_name || ' ' || j AS title, j = 2 AS drop, n_nationkey AS k FROM nation, range(1, 5) r(j) WHERE j <= n_nationkey % 4 UNION ALL SELECT n_name, 500, 'Suggested', '', false, n_nationkey FROM nation"


def _ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("rec"), F.lit(500).cast("long").alias("total"))


@query(f"SELECT rec, pos, state, title, drop FROM ({_SPLITS})")
def s15_edit_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.splits_of(_edits(spark, sf_dir), _ends(spark, sf_dir))


@query("SELECT 'new.json' AS name, 1 AS version, count(*) AS recordings FROM nation")
def k12_saved_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The folder after a save: the file of the former name is gone."""
    return _edits(spark, sf_dir).select(name_of().alias("name"), "doc.version", F.size("doc.recordings").cast("long").alias("recordings"))


@query("SELECT n_name AS rec FROM nation WHERE n_nationkey % 3 = 1")
def p6_done(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings whose edit says that they are done."""
    edits = _edits(spark, sf_dir).select(F.explode("doc.recordings").alias("rec", "edit"))
    return _ends(spark, sf_dir).join(edits.filter("edit.status = 'Done'"), "rec").select("rec")


@query(f"SELECT CASE WHEN rec = 'FRANCE' THEN 'GALLIA' ELSE rec END AS rec, count(*) AS splits FROM ({_SPLITS}) GROUP BY ALL")
def u4_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recording's edit under its new name."""
    edits = _edits(spark, sf_dir).select(F.explode("doc.recordings").alias("rec", "edit"))
    return edits.select(F.when(F.col("rec") == "FRANCE", "GALLIA").otherwise(F.col("rec")).alias("rec"), F.size("edit.splits").cast("long").alias("splits"))


@query(f"SELECT rec, count(*) AS splits FROM ({_SPLITS}) WHERE k % 5 <> 3 GROUP BY rec")
def u5_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits without those of deleted recordings."""
    gone = table(spark, sf_dir, "nation").filter("n_nationkey % 5 = 3").select(F.col("n_name").alias("rec"))
    edits = _edits(spark, sf_dir).select(F.explode("doc.recordings").alias("rec", "edit"))
    return edits.join(gone, "rec", "left_anti").select("rec", F.size("edit.splits").cast("long").alias("splits"))


@query(CTE + "SELECT rec, pos, CASE WHEN confirmed OR idx IN (1, 4) THEN 'Confirmed' ELSE 'Suggested' END AS state FROM splitc")
def e3_confirm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _after(spark, sf_dir, [("confirm", 1, None), ("confirm", 4, None), ("confirm", 1 << 40, None)])[0].select("rec", "pos", "state")


def _after(spark: SparkSession, sf_dir: str, ops: list[tuple]) -> tuple[DataFrame, DataFrame]:
    """(splits after the commands, what each command selects)."""
    r = Recording(spark, sf_dir)
    splits = r.splits.select("rec", "pos", F.when(F.col("confirmed"), "Confirmed").otherwise("Suggested").alias("state"), F.lit("").alias("title"), F.lit(False).alias("dropped"))
    listed = F.array(*[F.struct(F.lit(k).alias("seq"), F.lit(op).alias("op"), F.lit(at).cast("long").alias("k"), F.lit(pos).cast("long").alias("pos")) for k, (op, at, pos) in enumerate(ops)])
    todo = r.ends.select("rec", "total", F.explode(listed).alias("c")).select("rec", "total", "c.*")
    return commands.edited(splits, todo), commands.selections(splits, todo)


@query(CTE + """, s AS (SELECT rec, 0 AS seq, (SELECT min(idx) FROM splitc c WHERE c.rec = e.rec AND pos > 100) AS selected FROM ends e UNION ALL
SELECT rec, 1, (SELECT max(idx) FROM splitc c WHERE c.rec = e.rec AND pos < 100) FROM ends e UNION ALL
SELECT rec, 2, coalesce((SELECT min(idx) FROM splitc c WHERE c.rec = e.rec AND idx > 1 AND NOT confirmed), (SELECT min(idx) FROM splitc c WHERE c.rec = e.rec AND idx <> 1 AND NOT confirmed), CASE WHEN (SELECT count(*) FROM splitc c WHERE c.rec = e.rec) > 2 THEN 2 END) FROM ends e UNION ALL
SELECT rec, 3, (SELECT min(idx) - 1 FROM splitc c WHERE c.rec = e.rec AND idx > 1 AND NOT confirmed) FROM ends e) SELECT rec, seq, selected FROM s""")
def w12_review_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What Tab, Shift+Tab, Enter and Backspace select."""
    return _after(spark, sf_dir, [("next", None, 100), ("previous", None, 100), ("confirm_and_next", 1, 0), ("delete_and_next", 0, 0)])[1]


def _lines(spark: SparkSession, sf_dir: str) -> str:
    """A queue of events as JSON lines, with blank and broken lines between them."""
    folder = _folder(spark, "queue")
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), (F.col("event_id") * 60).alias("t"), F.col("event_type").alias("n"))
    text_sinks.append_lines(e.filter("id % 2 = 0"), f"{folder}/lines")
    text_sinks.append_lines(e.filter("id % 2 = 1"), f"{folder}/lines")
    broken = e.filter("id % 10 = 0").select(F.when(F.col("id") % 20 == 0, "").otherwise(F.concat(F.lit('{"id": '), "id", F.lit(', "t":'))).alias("value"))
    broken.write.mode("append").text(f"{folder}/lines")
    return f"{folder}/lines"


NOW, SCHEMA = 700_000, "id long, t long, n string"


@query(f"SELECT event_id AS id, event_type AS n FROM events WHERE event_id * 60 + 604800 >= {NOW}")
def s16_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.queue(spark, _lines(spark, sf_dir), SCHEMA, NOW).select("id", "n")


@query("SELECT event_id FROM events WHERE epoch(ts) + 604800 >= (SELECT max(epoch(ts)) FROM events)")
def p10_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the last seven days before the newest."""
    e = table(spark, sf_dir, "events")
    newest = e.agg(F.max("ts").alias("newest"))
    return e.join(F.broadcast(newest), F.col("ts") + F.expr("INTERVAL '7' DAY") >= F.col("newest")).select("event_id")


@query(f"SELECT event_id AS id FROM events WHERE event_id * 60 + 604800 >= {NOW} AND event_id % 3 = 0")
def k14_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queue after a part of it has been sent: the lines that are kept replace it."""
    kept = documents.queue(spark, _lines(spark, sf_dir), SCHEMA, NOW).filter("id % 3 = 0")
    target = _folder(spark, "kept")
    text_sinks.append_lines(kept, target)
    return documents.queue(spark, target, SCHEMA, NOW).select("id")


@query("SELECT event_id FROM events ORDER BY ts, event_id LIMIT 200")
def o4_first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request's rows: the feature is its limit."""
    return table(spark, sf_dir, "events").orderBy("ts", "event_id").limit(200).select("event_id")


@query("SELECT '2.0.' || n_nationkey AS version, CASE n_regionkey % 3 WHEN 0 THEN 'linux' WHEN 1 THEN 'macos' ELSE 'windows' END AS os, 'arm' || n_regionkey AS arch, 'https://x.example/' || n_name AS url FROM nation")
def s17_release_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark, "feeds")
    for k, name, region in nations(spark, sf_dir):
        feed = {"version": f"2.0.{k}", "platforms": {"linux": {}, "macos": {}, "windows": {}}}
        feed["platforms"][["linux", "macos", "windows"][region % 3]] = {f"arm{region}": {"url": f"https://x.example/{name}"}}
        put(f"{folder}/{k}.json", json.dumps(feed).encode())
    feeds = documents.documents(spark, folder, documents.RELEASES)
    return feeds.select("doc.version", F.explode("doc.platforms").alias("os", "by")).select("version", "os", F.explode("by").alias("arch", "at")).select("version", "os", "arch", "at.url")


@query("SELECT a.n_nationkey AS k, a.v AS version, CASE WHEN a.p > b.p THEN true ELSE false END AS newer FROM (SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN 'none' ELSE '1.' || n_nationkey || '.0' END AS v, CASE n_nationkey % 5 WHEN 0 THEN NULL ELSE n_nationkey END AS p FROM nation) a, (SELECT 9 AS p) b")
def j16_version_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published versions against the running one, a single row."""
    k = F.col("n_nationkey")
    offered = table(spark, sf_dir, "nation").select(k.cast("int").alias("k"), F.when(k % 5 == 0, "none").otherwise(F.concat(F.lit("1."), k, F.lit(".0"))).alias("version"))
    running = spark.createDataFrame([("1.9.0",)], "running string")
    return offered.join(F.broadcast(running)).select("k", "version", F.coalesce(texts.newer(F.col("version"), F.col("running")), F.lit(False)).alias("newer"))


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A change log: a release for each nation, with one or two sections."""
    n = table(spark, sf_dir, "nation")
    key = F.col("n_nationkey")
    some = [F.concat(F.lit("## [1."), key.cast("string"), F.lit(".0] - 2020-01-01")), F.lit("### Added"), F.concat(F.lit("- "), "n_name"), F.when(key % 2 == 0, F.lit("### Fixed")).otherwise(F.lit("")), F.lit("- more")]
    lines = n.select(F.lit("log").alias("path"), F.posexplode(F.array(*some)).alias("k", "line"), "n_nationkey")
    return documents.changes(lines.select("path", (F.col("n_nationkey") * 10 + F.col("k")).alias("n"), "line"))


@query("SELECT '1.' || n_nationkey || '.0' AS version, 'Added' AS heading, n_name AS item FROM nation UNION ALL SELECT '1.' || n_nationkey || '.0', CASE n_nationkey % 2 WHEN 0 THEN 'Fixed' ELSE 'Added' END, 'more' FROM nation")
def w15_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The section that each line of a change log stands in, filled on from the headings."""
    return _log(spark, sf_dir).select("version", "heading", "item")


@query("SELECT n_nationkey AS place, '1.' || n_nationkey || '.0' AS version, CASE n_nationkey % 2 WHEN 0 THEN 'Added: ' || n_name || '; Fixed: more' ELSE 'Added: ' || n_name || ', more' END AS sections FROM nation")
def k13_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed of a change log: releases in the log's order with their sections."""
    feed = text_sinks.release_feed(_log(spark, sf_dir)).select(F.posexplode("releases").alias("place", "r"))
    shown = F.array_join(F.transform("r.sections", lambda s: F.concat(s["heading"], F.lit(": "), F.array_join(s["items"], ", "))), "; ")
    return feed.select("place", "r.version", shown.alias("sections"))


def queries() -> dict:
    return {name: f for name, (f, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in REGISTRY.items()}
