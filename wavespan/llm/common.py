"""What the text operators share: rows, splits, words, and tables in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Python lists and strings of one step hold so many characters (of a column: UTF-8 bytes) at most, or one text.
STEP_CHARS = 1_000_000


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python, once for each Spark application."""
    context = spark.sparkContext
    name = f"wavespan-{context.applicationId}.zip"
    if not any(name in f for f in context.listFiles):
        top = Path(__file__).resolve().parents[2]
        target = Path(tempfile.mkdtemp()) / name  # read by the driver's file server alone
        with zipfile.ZipFile(target, "w") as out:
            for f in sorted((top / "wavespan").rglob("*.py")):
                out.write(f, f.relative_to(top))
        context.addPyFile(str(target))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def id_and_text(docs: DataFrame, *more) -> DataFrame:
    """(doc_id, text) and ``more``: other columns, also of clashing names, are dropped; a null text counts as empty."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def id_remainder(modulus: int):
    """crc32 of doc_id as text, mod ``modulus``; a null doc_id counts as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; only where the session names none, one for a single machine."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or "file:///tmp/checkpoints/wavespan"


#: Lets Spark remove a query's shuffle files when the query has ended; unknown to versions that lack it.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _files(spark: SparkSession, path: str):
    """(the path, its file system), which the driver's JVM knows."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def materialize(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write a table into the shared folder and read it back: cuts the lineage and survives lost executors.

    The table goes when the driver ends, or earlier by ``discard``; the write's own shuffle files go at once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/wavespan/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path, compression=compression)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    at, files = _files(spark, path)
    files.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._wavespan_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote and that nothing reads any more."""
    for table in tables:
        at, files = _files(table.sparkSession, table._wavespan_path)
        files.delete(at, True)


def steps(texts: list[str], chars: int = STEP_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts with at most ``chars`` characters in all, or one text."""
    start = total = 0
    for i, text in enumerate(texts):
        if i > start and total + len(text) > chars:
            yield start, i
            start, total = i, 0
        total += len(text)
    if start < len(texts):
        yield start, len(texts)


def arrow_steps(texts: pa.Array, size: int = STEP_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of a column without nulls with at most ``size`` UTF-8 bytes, or one text; no Python string is made."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + size, "right")))
        yield start, stop
        start = stop


def strings(texts: pa.Array, a: int, b: int) -> list[str]:
    return texts.slice(a, b - a).to_numpy(zero_copy_only=False).tolist()


def id_text_steps(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
    """The doc_id column and texts of small runs of rows, whole texts; only a run's texts are Python strings."""
    for batch in batches:
        ids, texts = batch.column("doc_id"), batch.column("text")
        for a, b in arrow_steps(texts):
            yield ids.slice(a, b - a), strings(texts, a, b)


def words(text: str) -> list[bytes]:
    """``[^\\x20\\x09-\\x0D]+`` as UTF-8 with A-Z in lower case: what bytes.split and bytes.lower do."""
    return text.encode("utf-8").lower().split()


def least_hashes(rows: DataFrame, key, most: int) -> DataFrame:
    """The ``most`` rows of the least 64-bit hash ``key``, or all if there are no more.

    A cut-off that follows from the rows' number leaves few more than ``most`` before any task sorts, so that tasks
    send about as many rows in all, not as many each.
    """
    count = rows.count()
    share = min((most + 6 * most**0.5 + 10) / max(count, 1), 1.0)
    cut = rows if share >= 1 else rows.filter(key <= F.lit(int(-(2**63) + share * 2**64)))
    return cut.orderBy(key, *rows.columns).limit(most)


def labelled_sample(docs: DataFrame, label_table: DataFrame, column: str, train, rows: int) -> DataFrame:
    """(doc_id, text, label) of at most ``rows`` labelled documents that ``train`` admits, by a hash of doc_id.

    Null labels are left out; where a doc_id has several, the largest counts. The drawn ids are
    broadcast: ``rows`` bounds them.
    """
    known = (
        label_table.filter(F.col(column).isNotNull() & F.col("doc_id").isNotNull())
        .filter(train)
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max(F.col(column)).cast("int").alias("label"))
    )
    return id_and_text(docs).join(F.broadcast(least_hashes(known, F.xxhash64("doc_id"), rows)), "doc_id")
