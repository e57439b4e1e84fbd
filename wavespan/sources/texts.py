"""JSON documents, queues of JSON lines, and change logs as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Positions are wider than 64 signed bits: the largest unsigned one stands for a recording's end.
POSITION = "decimal(20,0)"
CUTLIST = f"struct<version:int,recordings:map<string,struct<status:string,detected:boolean,head:struct<title:string,drop:boolean>,splits:array<struct<at:{POSITION},state:string,title:string,drop:boolean>>,silences:array<struct<start:{POSITION},end:{POSITION},keep:boolean>>>>>"
RELEASES = "struct<version:string,platforms:map<string,map<string,struct<url:string>>>>"


def documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(path, doc) of whole JSON files; one that doesn't parse is an error, never an empty document."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.from_json("value", schema, {"mode": "FAILFAST"}).alias("doc"))


def splits_of(cutlists: DataFrame, ends: DataFrame) -> DataFrame:
    """(rec, pos, state, title, drop): splits of all recordings, positions drawn in to the totals in ``ends`` (rec, total)."""
    each = cutlists.select(F.explode("doc.recordings").alias("rec", "edit")).select("rec", F.explode("edit.splits").alias("s"))
    return each.join(ends, "rec").select("rec", F.least(F.col("s.at"), F.col("total").cast(POSITION)).cast("long").alias("pos"), "s.state", "s.title", "s.drop")


def queue(spark: SparkSession, path: str, schema: str, now: int, age: int = 7 * 86_400) -> DataFrame:
    """Rows of JSON lines; lines that are blank or don't parse, and those whose ``t`` is older than ``age``, are dropped."""
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED").filter((F.col("t") + age) >= now)


def changes(lines: DataFrame) -> DataFrame:
    """(path, version, date, heading, item, place) of change logs given as (path, n, line).

    ``## [version] - date`` opens a release and ``---`` closes it, ``### heading`` opens a section, ``- text`` is an
    item, and an indented line goes on with the item before it. Each is a running last value or count by file.
    """
    order = Window.partitionBy("path").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    raw, line = F.col("line"), F.regexp_replace("line", r"\s+$", "")
    part = lambda pattern, k=1: F.when(line.rlike(pattern), F.regexp_extract(line, pattern, k))
    release, section, bullet = r"^##\s+\[([^\]]+)\]\s*(?:-\s*(\S+))?\s*$", r"^###\s+(.+?)\s*$", r"^-\s+(.+?)\s*$"
    rule = F.trim(line) == "---"
    marked = lines.select("path", "n", F.when(rule | line.rlike(release), F.col("n")).alias("mark"), F.trim(part(release)).alias("v"), part(release, 2).alias("d"), part(section).alias("h"), F.when(~rule, part(bullet)).alias("b"), F.when(raw.rlike(r"^[ \t]+\S") & ~rule, F.trim(line)).alias("more"))
    marked = marked.withColumn("block", F.max("mark").over(order))
    inside = Window.partitionBy("path", "block").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    whole = marked.filter("block IS NOT NULL").select("*", F.first("v").over(inside).alias("version"), F.first("d").over(inside).alias("date"), F.sum(F.when(F.col("h").isNotNull(), 1).otherwise(0)).over(inside).alias("part"))
    sections = Window.partitionBy("path", "block", "part").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    items = whole.filter("version IS NOT NULL").select("*", F.last("h", ignorenulls=True).over(inside).alias("heading"), F.count("b").over(sections).alias("k"))
    texts = items.filter("k > 0 AND (b IS NOT NULL OR more IS NOT NULL)").groupBy("path", "block", "version", "date", "part", "heading", "k")
    joined = texts.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", F.coalesce("b", "more").alias("text")))), lambda x: x["text"]), " ").alias("item"), F.min("n").alias("place"))
    return joined.select("path", "version", "date", F.coalesce("heading", F.lit("")).alias("heading"), "item", "place")
