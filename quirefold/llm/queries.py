"""The operators' queries over their whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quirefold.llm import bpe, chat, decontaminate, mixing, pii, quality_rules, sharding, simhash, spelling, substring, toxicity, url_rules, whitening
from quirefold.llm.common import scratch_path
from quirefold.llm.sql import ORACLES

__all__ = ["ORACLES", "QUERIES"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_rows", "host_failed", "host_rejected")


def op6_shard_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), map_path=scratch_path(spark, "slot-map")).drop("vslot")


def op7_repeated_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents"))


def op8_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op9_toxicity_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.graded(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_chat_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.recover(table(spark, sf_dir, "conversations"))


def op11_whitened(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.digest(table(spark, sf_dir, "embeddings"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), bpe.Vocabulary.read(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))


def op13_spelling_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_forms(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_simhash_dedup": op2_simhash_dedup,
    "op3_url_rules": op3_url_rules,
    "op4_decontaminate": op4_decontaminate,
    "op5_quality_rules": op5_quality_rules,
    "op6_shard_slots": op6_shard_slots,
    "op7_repeated_phrases": op7_repeated_phrases,
    "op8_pii_spans": op8_pii_spans,
    "op9_toxicity_grades": op9_toxicity_grades,
    "op10_chat_roles": op10_chat_roles,
    "op11_whitened": op11_whitened,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_spelling_forms": op13_spelling_forms,
}
