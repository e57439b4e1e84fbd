"""Files of any store that pyarrow opens, listed by Spark and read in ranges by tasks; and the cluster's shared folder."""

from __future__ import annotations

import re
import tempfile
import zipfile
from pathlib import Path

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavespan.functions import texts


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; only where the session names none, one for a single machine."""
    return (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or "file:///tmp/checkpoints/wavespan").rstrip("/")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python, once for each Spark application."""
    context = spark.sparkContext
    name = f"wavespan-files-{context.applicationId}.zip"
    if not any(name in f for f in context.listFiles):
        top, target = Path(__file__).resolve().parents[2], Path(tempfile.mkdtemp()) / name  # read by the driver's file server alone
        with zipfile.ZipFile(target, "w") as out:
            for f in sorted((top / "wavespan").rglob("*.py")):
                out.write(f, f.relative_to(top))
        context.addPyFile(str(target))


def tasks(spark: SparkSession) -> int:
    """A number of partitions for rows that are small but much work, which adaptive execution would put into one task."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)


def store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or local path as Spark writes it, and the path there."""
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", re.sub(r"^file:/(?!/)", "file:///", uri if ":" in uri else f"file://{uri}")).replace(" ", "%20"))


def recordings(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, modified, kind) of the audio and video files right in a folder, by lower-cased name.

    Names that begin with ``._`` are left out. The content column is pruned: no file is read.
    """
    name = F.regexp_extract("path", "([^/]*)$", 1)
    files = spark.read.format("binaryFile").load(folder).select("path", "length", F.col("modificationTime").alias("modified"), texts.media_kind(F.col("path")).alias("kind"))
    return files.filter(F.col("kind").isNotNull() & ~name.startswith("._")).orderBy(F.lower(name), name)


def stale(files: DataFrame, scans: DataFrame) -> DataFrame:
    """Files without a scan of the same path, length and modification time."""
    return files.join(scans, ["path", "length", "modified"], "left_anti")


def byte_slice(uri: str, start: int, stop: int, step: int = 1 << 20):
    """Bytes [start, stop) of a file in runs of at most ``step``."""
    system, path = store(uri)
    with system.open_input_file(path) as f:
        for at in range(start, min(stop, f.size()), step):
            yield f.read_at(min(step, stop - at), at)


class Slice:
    """Bytes [start, stop) of a file as a file of its own."""

    def __init__(self, uri: str, start: int, stop: int):
        system, path = store(uri)
        self.file = system.open_input_file(path)
        self.start, self.length = start, max(min(stop, self.file.size()) - start, 0)

    def size(self) -> int:
        return self.length

    def read_at(self, count: int, at: int) -> bytes:
        return self.file.read_at(max(min(count, self.length - at), 0), self.start + at)


def slices(parts: DataFrame, step: int = 1 << 20) -> DataFrame:
    """(path, start, at, content) of parts (path, start, stop) of files, in runs of at most ``step`` bytes."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                for k, content in enumerate(byte_slice(row["path"], row["start"], row["stop"], step)):
                    yield pa.RecordBatch.from_arrays([pa.array([row["path"]]), pa.array([row["start"]], pa.int64()), pa.array([row["start"] + k * step], pa.int64()), pa.array([content], pa.binary())], names=["path", "start", "at", "content"])

    ship(parts.sparkSession)
    return parts.select("path", "start", "stop").mapInArrow(run, "path string, start long, at long, content binary")
