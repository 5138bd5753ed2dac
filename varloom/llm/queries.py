"""Registered queries of the numbered operators and the DuckDB statements that check them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from varloom.llm import common, decontam, jaccard, katz, langid, mixing, quality, resample, secrets, suffix, surrogates, tokens, warc, whiten
from varloom.llm.oracles import ORACLES

__all__ = ["ORACLES", "QUERIES"]
END_ID = 2
#: Key of the registered query; whoever runs the operator passes a secret of their own.
SURROGATE_KEY = b"varloom registered query"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict_split(common.documents(spark, sf_dir))


def op2_keyed_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    return surrogates.replace(docs, SURROGATE_KEY)


def op3_pigeonhole_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op4_adaptive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(common.documents(spark, sf_dir))


def op5_capped_water_filling(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(common.documents(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "reps")


def op6_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(common.documents(spark, sf_dir))


def op7_multi_order_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(common.documents(spark, sf_dir))


def op8_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op9_token_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_files(common.documents(spark, sf_dir), tokenizer_path(), END_ID)


def op10_interval_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix.remove_repeats(common.documents(spark, sf_dir))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op11_position_table_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.draw(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_refined_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_randomness_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(common.documents(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_mixture,
        op2_keyed_surrogates,
        op3_pigeonhole_decontamination,
        op4_adaptive_quality,
        op5_capped_water_filling,
        op6_katz_backoff,
        op7_multi_order_jaccard,
        op8_warc_segments,
        op9_token_columns,
        op10_interval_expansion,
        op11_position_table_resampling,
        op12_refined_whitening,
        op13_randomness_battery,
    )
}
