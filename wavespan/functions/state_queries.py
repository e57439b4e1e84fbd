"""The functions of states.py over whole tables, each beside SQL of its own; both start from the same derived columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavespan.functions import states, texts

#: Inputs, in words that both engines read alike.
INPUTS = [
    "event_id",
    "CASE event_id % 4 WHEN 0 THEN 24 WHEN 1 THEN 16 WHEN 2 THEN 8 END AS bits",
    "CASE event_id % 5 WHEN 0 THEN 'original' WHEN 1 THEN 'mp3_vbr' WHEN 2 THEN 'mp3_cbr' WHEN 3 THEN 'flac' ELSE 'wav16' END AS profile",
    "CASE event_id % 5 WHEN 1 THEN event_id % 12 ELSE 32 + event_id % 10 * 32 END AS setting",
    "14 + event_id % 14 AS crf",
    "CASE event_id % 3 WHEN 0 THEN 'off' WHEN 1 THEN 'album' ELSE 'track' END AS loud",
    "-10 - event_id % 9 AS target",
    "CASE event_id % 8 WHEN 0 THEN NULL WHEN 1 THEN '  ' WHEN 2 THEN 'No' WHEN 3 THEN ' 0 ' WHEN 4 THEN 'FALSE' WHEN 5 THEN 'yes' WHEN 6 THEN '' ELSE 'off' END AS word",
    "CASE event_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS answer",
    "event_id % 5 = 0 AS informed",
    "event_id % 7 = 0 AS blocked",
    "CASE WHEN event_id % 2 = 0 THEN 'there' END AS endpoint",
    "CASE event_id % 6 WHEN 0 THEN 'cbr' WHEN 1 THEN 'vbr' WHEN 2 THEN 'avg' WHEN 3 THEN 'pcm' WHEN 4 THEN 'unknown' ELSE 'none' END AS kind",
    "96 + event_id % 64 AS kbps",
    "event_id * 4321 AS size",
    "CAST(event_id % 4000 AS DOUBLE) / 8 AS secs",
    "CASE WHEN event_id % 2 = 0 THEN 44100 ELSE 96000 END AS rate",
    "1 + event_id % 3 AS channels",
    "event_id % 11 = 0 AS silent",
    "CASE event_id % 6 WHEN 0 THEN 'queued' WHEN 1 THEN 'measuring' WHEN 2 THEN 'installing' WHEN 3 THEN 'running' WHEN 4 THEN 'failed' ELSE 'finished' END AS export",
    "event_id % 10 AS done",
    "event_id % 13 AS of",
    "CAST(event_id % 8 AS DOUBLE) / 8 AS part",
    "CASE event_id % 5 WHEN 0 THEN 'Todo' WHEN 1 THEN 'InProgress' WHEN 2 THEN 'Flagged' WHEN 3 THEN 'Done' ELSE 'Exported' END AS status",
    "CASE event_id % 7 WHEN 0 THEN 'select' WHEN 1 THEN 'flag' WHEN 2 THEN 'finish' WHEN 3 THEN 'exported' ELSE 'scroll' END AS action",
    "CASE event_id % 4 WHEN 0 THEN 'quieter' WHEN 1 THEN 'louder' WHEN 2 THEN 'shorter' ELSE 'longer' END AS turn",
    "CAST(-40 + event_id % 12 * 3 AS DOUBLE) AS threshold",
    "CAST(event_id % 9 AS DOUBLE) / 8 AS silence",
    "event_id % 2 = 0 AS detected",
    "event_id % 3 = 0 AS tagged",
    "event_id * 7 % 9001 AS start",
    "100 + event_id % 900 AS span",
    "event_id * 13 % 10007 AS total",
    "event_id * 31 % 10007 AS pos",
]
X = f"(SELECT {', '.join(INPUTS)} FROM events) x"
C = F.col
REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {}


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(*INPUTS)


def _event(name: str, sql: str, **columns: Callable[[], Column]) -> None:
    """Registers a query of event_id and some columns; ``sql`` gives the same columns over the inputs."""
    REGISTRY[name] = (lambda spark, sf_dir: _events(spark, sf_dir).select("event_id", *[make().alias(c) for c, make in columns.items()]), f"SELECT event_id, {sql} FROM {X}")


_HELD = "greatest(least({}, total - span), 0)"
_CLOCK = "CASE WHEN secs >= 3600 THEN printf('%d:%02d:%02d', CAST(floor(secs) AS BIGINT) // 3600, CAST(floor(secs) AS BIGINT) // 60 % 60, CAST(floor(secs) AS BIGINT) % 60) ELSE printf('%d:%02d', CAST(floor(secs) AS BIGINT) // 60, CAST(floor(secs) AS BIGINT) % 60) END"
_VBR = "list_extract([245, 225, 190, 175, 165, 130, 115, 100, 85, 65], CAST(least(setting, 9) + 1 AS INT))"
_event("f9_flac_bits", "CASE WHEN coalesce(bits, 0) <= 16 THEN 16 ELSE 24 END AS depth", depth=lambda: states.flac_depth(C("bits")))
_event(
    "f14_labels",
    f"""CASE profile WHEN 'original' THEN 'Original (lossless copy)' WHEN 'flac' THEN 'FLAC (lossless)' WHEN 'wav16' THEN 'WAV 16-bit' WHEN 'mp3_cbr' THEN printf('MP3 CBR %d kbps', setting) ELSE printf('MP3 VBR V%d (~%d kbps)', setting, {_VBR}) END AS label,
    CASE profile WHEN 'original' THEN 'Original' WHEN 'flac' THEN 'FLAC' WHEN 'wav16' THEN 'WAV 16' WHEN 'mp3_cbr' THEN 'MP3 ' || setting || 'k' ELSE 'MP3 V' || setting END AS short,
    'MP4 · ' || CASE WHEN crf > 23 THEN 'small files' WHEN crf > 18 THEN 'standard' ELSE 'high quality' END AS video,
    CASE loud WHEN 'off' THEN 'Loudness unchanged' WHEN 'album' THEN printf('Whole recording to %d LUFS', target) ELSE printf('Each track to %d LUFS', target) END AS loudness""",
    label=lambda: states.profile_label(C("profile"), C("setting")), short=lambda: states.profile_short(C("profile"), C("setting")), video=lambda: states.video_label(C("crf")), loudness=lambda: states.loudness_label(C("loud"), C("target")),
)
_event("f42_flag", "NOT (word IS NULL OR regexp_matches(word, '^ *(0|false|no)? *$', 'i')) AS flag", flag=lambda: states.flag(C("word")))
_event("f43_consent", "CASE WHEN endpoint IS NULL OR blocked THEN false WHEN answer IS NULL THEN informed ELSE answer END AS sends", sends=lambda: states.may_send(C("endpoint"), C("blocked"), C("answer"), C("informed")))
_event(
    "f46_title", "CASE WHEN regexp_matches(coalesce(word, '?'), '^ *$') AND detected THEN profile ELSE trim(word) END AS title",
    title=lambda: states.accepted_title(C("word"), F.concat(F.lit(" "), C("profile"), F.lit(" ")), C("detected")),
)
_event(
    "p9_source_facts", "CASE WHEN kind IN ('unknown', 'none') THEN CAST(trunc(size / 125e0 / CASE WHEN secs < 1 THEN 1 ELSE secs END) AS BIGINT) ELSE kbps END AS kbps, kind <> 'pcm' AS lossy",
    kbps=lambda: states.source_facts(C("kind"), C("kbps"), C("size"), C("secs"))["kbps"], lossy=lambda: states.source_facts(C("kind"), C("kbps"), C("size"), C("secs"))["lossy"],
)
_event(
    "p12_chips",
    f"""concat_ws(' | ', profile, CASE WHEN NOT silent THEN CASE kind WHEN 'cbr' THEN 'CBR ' || kbps || ' kbps' WHEN 'vbr' THEN printf('VBR %d–%d kbps (avg %d)', kbps - 9, kbps + 9, kbps) WHEN 'avg' THEN '~' || kbps || ' kbps' WHEN 'pcm' THEN kbps || ' kbps' WHEN 'unknown' THEN 'bitrate unknown' ELSE '' END END,
    CASE WHEN NOT silent THEN CASE rate WHEN 44100 THEN '44.1 kHz' ELSE '96.0 kHz' END END, CASE WHEN NOT silent THEN CASE channels WHEN 1 THEN 'mono' WHEN 2 THEN 'stereo' ELSE channels || ' ch' END END, {_CLOCK}, printf('%.1f MB', size / 1048576e0)) AS chips""",
    chips=lambda: F.array_join(states.chips(C("profile"), states.bitrate_label(C("kind"), C("kbps"), C("kbps") - 9, C("kbps") + 9), C("rate"), C("channels"), C("secs"), C("size"), C("silent")), " | "),
)
_event("a15_progress", "CASE export WHEN 'running' THEN (done + part) / CASE of WHEN 0 THEN 1 ELSE of END END AS fraction", fraction=lambda: states.export_fraction(C("export"), C("done"), C("of"), C("part")))
_event(
    "e11_status",
    "CASE action WHEN 'finish' THEN 'Done' WHEN 'exported' THEN 'Exported' WHEN 'flag' THEN CASE status WHEN 'Flagged' THEN 'InProgress' ELSE 'Flagged' END WHEN 'select' THEN replace(status, 'Todo', 'InProgress') ELSE status END AS status",
    status=lambda: states.status_after(C("status"), C("action")),
)
_event(
    "e14_detect_params",
    "threshold + CASE turn WHEN 'quieter' THEN -3 WHEN 'louder' THEN least(3, -6 - threshold) ELSE 0 END AS threshold, CASE turn WHEN 'longer' THEN silence + 0.25e0 WHEN 'shorter' THEN CASE WHEN silence < 0.5 THEN 0.25e0 ELSE silence - 0.25e0 END ELSE silence END AS silence",
    threshold=lambda: states.detect_settings(C("threshold"), C("silence"), C("turn"))["threshold"], silence=lambda: states.detect_settings(C("threshold"), C("silence"), C("turn"))["silence"],
)
_event("e15_auto_detect", "CASE WHEN detected AND tagged THEN 'nothing' WHEN detected THEN 'tag' ELSE 'detect and tag' END AS step", step=lambda: states.detection_step(C("detected"), C("tagged")))
_event(
    "f35_view",
    f"""CASE WHEN pos BETWEEN start AND start + span - 1 THEN start ELSE {_HELD.format("pos - span // 10")} END AS revealed, {_HELD.format("pos - span // 2")} AS centred, {_HELD.format("start + pos - 5000")} AS scrolled,
    CASE WHEN pos BETWEEN start AND start + span * 97 // 100 - 1 THEN start ELSE {_HELD.format("pos - span * 3 // 100")} END AS followed""",
    revealed=lambda: states.revealed(C("start"), C("span"), C("total"), C("pos"), False), centred=lambda: states.revealed(C("start"), C("span"), C("total"), C("pos"), True),
    scrolled=lambda: states.scrolled(C("start"), C("span"), C("total"), C("pos") - 5000), followed=lambda: states.followed(C("start"), C("span"), C("total"), C("pos")),
)


def _table(name: str, sql: str):
    def register(build):
        REGISTRY[name] = (lambda spark, sf_dir: build(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")), sql)
        return build

    return register


@_table("p11_published", "SELECT event_id, event_id % 2 = 0 AND event_id % 3 > 0 AS shown FROM events")
def _published(read):
    number = F.concat((C("event_id") % 3).cast("string"), F.lit(".1"), F.when(C("event_id") % 2 == 0, ".10").otherwise(""))
    return read("events").select("event_id", texts.published(number, F.when(C("event_id") % 3 > 0, "2026-01-02").otherwise("2 January")).alias("shown"))


@_table("o1_sort_names", "SELECT c_custkey, c_name FROM customer ORDER BY lower(c_name), c_name, c_custkey")
def _names(read):
    """A sort by ranges over all tasks; numbering the rows in one window would put them into one."""
    return read("customer").select("c_custkey", "c_name").orderBy(F.lower("c_name"), "c_name", "c_custkey")


@_table("o3_version_sort", "SELECT event_id, version FROM (SELECT event_id, event_id % 3 AS a, event_id % 12 AS b, event_id % 101 AS c, concat_ws('.', event_id % 3, event_id % 12, event_id % 101) AS version FROM events) ORDER BY a DESC, b DESC, c DESC, event_id")
def _versions(read):
    part = lambda n: (C("event_id") % n).cast("string")
    named = read("events").select("event_id", F.concat_ws(".", part(3), part(12), part(101)).alias("version"))
    return named.orderBy(texts.version(C("version")).desc(), "event_id")


@_table("a14_counters", f"SELECT count(*) AS n, count(*) FILTER (WHERE status = 'Done') AS done, count(*) FILTER (WHERE export NOT IN ('failed', 'finished')) AS active FROM {X}")
def _counters(read):
    return read("events").selectExpr(*INPUTS).agg(F.count(F.lit(1)).alias("n"), F.count_if(C("status") == "Done").alias("done"), F.count_if(states.is_active(C("export"))).alias("active"))


@_table("e7_toggle", "SELECT u.user_id AS rec, i.idx, (i.idx = 3) <> (coalesce(p.n, 0) % 2 = 1) AS dropped FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS idx) i LEFT JOIN (SELECT user_id, event_id % 5 AS idx, count(*) AS n FROM events GROUP BY ALL) p ON p.user_id = u.user_id AND p.idx = i.idx")
def _toggled(read):
    tracks = read("events").select(C("user_id").alias("rec")).distinct().select("rec", F.explode(F.array(*map(F.lit, range(4)))).alias("idx")).withColumn("dropped", C("idx") == 3)
    return states.toggled(tracks, read("events").select(C("user_id").alias("rec"), (C("event_id") % 5).alias("idx")))


@_table("w11_budget_prefix", "SELECT event_type AS queue, event_id AS seq, props AS line FROM (SELECT *, row_number() OVER w AS k, sum(strlen(props) + 1) OVER w AS used FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id)) WHERE k = 1 OR (k < 201 AND used <= 4000)")
def _batch(read):
    return states.next_batch(read("events").select(C("event_type").alias("queue"), C("event_id").alias("seq"), C("props").alias("line")))


@_table(
    "j9_sidebar",
    """WITH e AS (SELECT o_custkey AS rec, count(*) FILTER (WHERE o_orderstatus = 'F') AS ok, count(*) FILTER (WHERE o_orderstatus <> 'F' AND o_custkey % 2 = 0) AS todo FROM orders GROUP BY 1)
    SELECT c_custkey AS rec, CASE WHEN c_custkey % 7 = 0 THEN 'exporting 2/9' WHEN c_custkey % 7 = 1 THEN 'export failed' WHEN c_custkey % 7 = 2 THEN 'measuring…'
      WHEN c_custkey % 5 = 0 THEN '…' WHEN c_custkey % 5 = 1 THEN '25%' WHEN c_custkey % 5 = 2 THEN 'error' WHEN todo > 0 THEN todo || ' to review' WHEN ok > 0 THEN (ok + 1) || ' tracks ✓'
      ELSE printf('%d:%02d', c_custkey % 3000 // 60, c_custkey % 60) END AS status FROM customer LEFT JOIN e ON e.rec = c_custkey""",
)
def _sidebar(read):
    key = read("customer").select(C("c_custkey").alias("rec"))
    done = C("o_orderstatus") == "F"
    edits = read("orders").groupBy(C("o_custkey").alias("rec")).agg(F.count_if(done).alias("confirmed"), F.count_if(~done & (C("o_custkey") % 2 == 0)).alias("open"))
    scans = key.filter("rec % 5 > 0").select("rec", F.when(C("rec") % 5 == 1, "scanning").when(C("rec") % 5 == 2, "failed").otherwise("ready").alias("scan"), F.lit(0.25).alias("progress"), (C("rec") % 3000).cast("double").alias("secs"))
    exports = key.filter("rec % 7 < 4").select("rec", F.element_at(F.array(*map(F.lit, ("running", "failed", "measuring", "finished"))), (C("rec") % 7 + 1).cast("int")).alias("export"), F.lit(2).alias("done"), F.lit(9).alias("of"))
    return states.sidebar(key, edits, scans, exports)


def queries() -> dict:
    return {name: f for name, (f, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in REGISTRY.items()}
