"""Documents to packed training sequences, in stages that are each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wavespan.llm import packing, quality, simhash, tokens, toxicity
from wavespan.llm.common import discard, documents, id_remainder, labels, materialize


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; the others keep their columns, whatever these are called.

    Null and empty texts count as texts without terms, each of repeated rows is judged, and of an empty table nothing
    stays. Without labels the model says the smoothed share of toxic rows, under the threshold: all stay.
    """
    machine = toxicity.fit(docs, labels(spark, sf_dir), id_remainder(4) != 2)
    return toxicity.keep(docs, lambda texts: [machine.score(t) < toxicity.THRESHOLD for t in texts])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; the others keep their columns, whatever these are called.

    Null and empty texts have the score of the bias, each of repeated rows is judged, and of an empty table nothing
    stays. Without labels every score is a half: all stay.
    """
    model = quality.fit(docs, labels(spark, sf_dir), id_remainder(5) != 0)
    return toxicity.keep(docs, lambda texts: (model.scores(texts) >= quality.THRESHOLD).tolist())


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that of the smallest doc_id, with its columns.

    Of equal rows one stays; rows that share a doc_id only are different documents. See ``drop_near_duplicates``.
    """
    return simhash.drop_near_duplicates(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens with their sequences, each row's on its own; null texts are the separator alone."""
    return packing.pack(packing.token_pieces(docs, tokens.tokenizer_path("byte_bpe_50k.json")))


STAGES = [
    ("toxicity", toxicity_stage),
    ("quality classifier", quality_stage),
    ("simhash near-dedup", near_duplicate_stage),
    ("best-fit packing", packing_stage),
]

#: SQL can't express the trained stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's rows are written to the shared folder and read as the next one's; a stage's input then goes."""
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
        if before is not None:
            discard(before)
        before = docs
    return docs
