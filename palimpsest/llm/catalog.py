"""The queries of the operators over the tables of a folder, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm.alignment import alignment_report
from palimpsest.llm.audio import match_recordings, recordings
from palimpsest.llm.common import table
from palimpsest.llm.infill import infill_report, infill_sql
from palimpsest.llm.jaccard import jaccard_components
from palimpsest.llm.langid import identify_languages
from palimpsest.llm.lines import line_report, line_sql
from palimpsest.llm.mixing import mixing_report, mixing_sql
from palimpsest.llm.packing import pack
from palimpsest.llm.pii import find_personal_data
from palimpsest.llm.quality import quality_report, quality_sql
from palimpsest.llm.repeats import repeated_strings
from palimpsest.llm.rulefit import quality_scores
from palimpsest.llm.secrets import scan_secrets


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_strings(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(table(spark, sf_dir, "documents"))


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match_recordings(recordings(table(spark, sf_dir, "embeddings"))).withColumnRenamed("id", "vec_id")


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))


def op8_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_report(table(spark, sf_dir, "documents"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(table(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill_report(table(spark, sf_dir, "documents"))


def op12_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment_report(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_ngram_jaccard_join, op2_suffix_array_dedup, op3_quality_rules, op4_secret_scans, op5_media_columns, op6_personal_data, op7_language_id, op8_poisson_mixing, op9_best_fit_packing, op10_line_dedup, op11_fill_in_middle, op12_rule_ensemble, op13_token_alignment)}


def oracle_sql() -> dict[str, str]:
    return {"op3_quality_rules": quality_sql(), "op8_poisson_mixing": mixing_sql(), "op10_line_dedup": line_sql(), "op11_fill_in_middle": infill_sql()}
