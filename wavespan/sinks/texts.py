"""JSON documents and queues of JSON lines as files."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavespan.sinks.tracks import write
from wavespan.sources.files import store


def save_document(document: DataFrame, target: str, legacy: str | None = None) -> None:
    """A table's single row as an indented JSON file; then the file of the former name goes."""
    text = document.select(F.to_json(F.struct("*"), {"pretty": "true"})).first()[0]
    write(target, iter([text.encode()]))
    if legacy:
        system, path = store(legacy)
        if system.get_file_info(path).is_file:
            system.delete_file(path)


def release_feed(changes: DataFrame) -> DataFrame:
    """One row (releases) of versions with their sections and items, in the change log's order, by path."""
    items = changes.groupBy("path", "version", "date", "heading").agg(F.sort_array(F.collect_list(F.struct("place", "item"))).alias("rows"))
    sections = items.groupBy("path", "version", "date").agg(F.sort_array(F.collect_list(F.struct(F.col("rows")[0]["place"].alias("place"), "heading", F.col("rows.item").alias("items")))).alias("rows"))
    plain = F.transform("rows", lambda r: F.struct(r["heading"].alias("heading"), r["items"].alias("items")))
    each = sections.select("path", F.struct(F.col("rows")[0]["place"].alias("place"), "version", "date", plain.alias("sections")).alias("r"))
    ordered = each.groupBy("path").agg(F.sort_array(F.collect_list("r")).alias("rs"))
    return ordered.select("path", F.transform("rs", lambda r: F.struct(r["version"].alias("version"), r["date"].alias("date"), r["sections"].alias("sections"))).alias("releases"))


def append_lines(rows: DataFrame, folder: str) -> None:
    rows.write.mode("append").json(folder)


def rewrite_lines(lines: Iterator[str], target: str) -> None:
    """The kept lines replace the file; without any it goes."""
    kept = [f"{line}\n".encode() for line in lines]
    if kept:
        write(target, iter(kept))
    else:
        system, path = store(target)
        if system.get_file_info(path).is_file:
            system.delete_file(path)
