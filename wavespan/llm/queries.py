"""Queries over whole tables, one for each text operator, at production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavespan.llm import edits, licenses, media, packing, pitman_yor, quality, rules, simhash, tokens, toxicity
from wavespan.llm.common import documents, id_remainder, labels


def _scored(scores: DataFrame, held_out, threshold: float) -> DataFrame:
    return scores.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = id_remainder(4) == 2
    return _scored(toxicity.toxicity(documents(spark, sf_dir), labels(spark, sf_dir), ~held_out), held_out, toxicity.THRESHOLD)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(documents(spark, sf_dir))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.token_pieces(documents(spark, sf_dir), tokens.tokenizer_path("byte_bpe_50k.json")))


def edits_of(docs: DataFrame) -> DataFrame:
    """Three edits for each text: a cut after a third, words put into the middle of what is left, another ending."""
    n = F.length(F.coalesce("text", F.lit(""))).cast("long")
    third, cut = F.floor(n / 3), F.least(F.lit(40), n - F.floor(n / 3))
    middle, end = F.floor((n - cut) / 2), n - cut + len(" an edited passage ")
    one = lambda a, b, text: F.struct(a.cast("long").alias("start"), b.cast("long").alias("stop"), F.lit(text).alias("replacement"))
    return docs.select("doc_id", "text", F.array(one(third, third + cut, ""), one(middle, middle, " an edited passage "), one(end - 10, end, "\nThe end.")).alias("edits"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edits.edited_token_counts(edits_of(documents(spark, sf_dir)), tokens.tokenizer_path("byte_bpe_50k.json"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = id_remainder(5) == 0
    return _scored(quality.quality(documents(spark, sf_dir), labels(spark, sf_dir), ~held_out), held_out, quality.THRESHOLD)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.piece_digest(documents(spark, sf_dir), tokens.tokenizer_path("piece_bpe_32k.model"))


def op8_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digest(documents(spark, sf_dir))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.forest_verdicts(documents(spark, sf_dir), labels(spark, sf_dir).filter(id_remainder(5) != 0))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pitman_yor.score_texts(documents(spark, sf_dir), id_remainder(10) != 0)
    return found.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def queries() -> dict:
    return {f.__name__: f for f in (op1_toxicity, op2_license_scan, op3_best_fit_packing, op4_token_counts, op5_simhash, op6_quality, op7_sentencepiece, op8_audio, op9_quality_rules, op10_lm_scoring)}


def oracle_sql() -> dict[str, str]:
    """None: tests compare each query with a brute-force version, a round trip or held-out labels."""
    return {}
