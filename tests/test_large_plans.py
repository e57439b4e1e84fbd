"""Queries as planned for large tables, where joins are dealt by shuffles and adaptive execution then changes their mind."""

import shutil

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tests.test_oracles import rows
from wavespan import catalog
from wavespan.sinks import tracks
from wavespan.sources import files, wav

#: A join by shuffles in as many partitions as rows are dealt to, whose smaller side adaptive execution broadcasts.
PLAN = {"spark.sql.shuffle.partitions": "12", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "20KB", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
QUERIES = ["s4_wav_layout", "k8_whole_file", "s3_wav_samples", "k2_wav_range", "s13_scan", "k9_apply_cuts", "s5_pcm_range", "k7_wav16"]


@pytest.fixture
def large(spark):
    before = {name: spark.conf.get(name, None) for name in PLAN}
    for name, value in PLAN.items():
        spark.conf.set(name, value)
    yield spark
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    """The events in a place of their own, so that their signal is imported under this plan."""
    folder = tmp_path_factory.mktemp("tables")
    shutil.copy(f"{SF}/events.parquet", folder)
    return str(folder)


def test_a_target_is_written_by_one_task(large, tmp_path):
    frame = F.floor(F.col("id") / 3)
    samples = large.range(0, 3000, 1, 6).select(F.concat(F.lit(f"file://{tmp_path}/"), (F.col("id") % 3).cast("string"), F.lit(".wav")).alias("target"), frame.alias("frame"), F.lit(0).alias("channel"), (frame / 32768).alias("value"))
    done = tracks.write_samples(samples, 8000).collect()
    assert sorted((r.target[-5:], r.frames) for r in done) == [(f"{k}.wav", 1000) for k in range(3)]
    heard = wav.samples(wav.layouts(files.recordings(large, f"file://{tmp_path}")))
    assert heard.count() == 3000 and heard.filter(F.round(F.col("value") * 32768) != F.col("frame")).isEmpty()


@pytest.mark.parametrize("name", QUERIES)
def test_query_matches_sql(large, tables, name):
    duck = duckdb.connect()
    duck.sql(f"create view events as select * from '{tables}/events.parquet'")
    assert rows(catalog.queries()[name](large, tables).toPandas()) == rows(duck.sql(catalog.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", ["f29_utc_label", "k3_cut_plan", "p12_chips"])
def test_large_keys_match_sql(spark, tmp_path, name):
    """Keys up to those of 60 times sf0.1."""
    spark.range(0, 6_000_000, 4096).selectExpr("id AS event_id", "'view' AS event_type", "1.0D AS value").write.parquet(f"{tmp_path}/events.parquet")
    duck = duckdb.connect()
    duck.sql(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    assert rows(catalog.queries()[name](spark, str(tmp_path)).toPandas()) == rows(duck.sql(catalog.oracle_sql()[name]).df())
