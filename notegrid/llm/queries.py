"""The thin opN queries over whole tables, and the pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from notegrid.llm import decontam, htmltext, langid, licenses, mixing, pii, quality, sharding, simhash, tokens
from notegrid.llm.sql import ORACLES

#: Tokenizer file, as public_tokenizers names it.
TOKENIZER = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark, sf_dir):
    return mixing.mix_report(table(spark, sf_dir, "documents")).drop("copies")


def op2_license_scan(spark, sf_dir):
    return licenses.license_report(table(spark, sf_dir, "documents"))


def op3_token_counts(spark, sf_dir):
    import public_tokenizers

    return tokens.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op4_main_text(spark, sf_dir):
    return htmltext.main_text(table(spark, sf_dir, "pages"))


def op5_simhash_golay(spark, sf_dir):
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op6_quality_ratio(spark, sf_dir):
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    out = quality.quality(table(spark, sf_dir, "documents"), trusted)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")


def op7_language_mixture(spark, sf_dir):
    return langid.language_id(table(spark, sf_dir, "documents"))


def op8_personal_data(spark, sf_dir):
    return pii.pii_report(table(spark, sf_dir, "documents"))


def op9_extendible_shards(spark, sf_dir):
    return sharding.shard_report(table(spark, sf_dir, "documents"))


def op10_benchmark_edits(spark, sf_dir):
    return decontam.contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def license_base(spark, sf_dir):
    """The base columns of op2, which SQL can make."""
    return op2_license_scan(spark, sf_dir).drop("labels", "score")


def quality_base(spark, sf_dir):
    """The base columns of op6, which SQL can make."""
    return op6_quality_ratio(spark, sf_dir).drop("kept", "llr")


def personal_counts(spark, sf_dir):
    """The counts of op8's base spans, which SQL can make."""
    return op8_personal_data(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


def queries() -> dict:
    return {f.__name__: f for f in (op1_mix_sources, op2_license_scan, op3_token_counts, op4_main_text, op5_simhash_golay, op6_quality_ratio,
                                    op7_language_mixture, op8_personal_data, op9_extendible_shards, op10_benchmark_edits, license_base, quality_base, personal_counts)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
