"""Registered queries of the operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from zoneforge.llm import alignment, collocations, cotraining, decision_list, exact_dedup, mixing, packing, simhash, substring_dedup, surrogates, token_file, toxicity, warc
from zoneforge.llm.common import read


def op1_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.anonymize(read(spark, sf_dir, "documents"))


def op2_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotraining.score_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"))


def op5_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decision_list.filter_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_dedup(read(spark, sf_dir, "documents"))


def op7_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file.round_trip(read(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(read(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(read(spark, sf_dir, "documents")).drop("removed")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(read(spark, sf_dir, "documents"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read(spark, sf_dir, "pages"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.phrases(read(spark, sf_dir, "documents"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_surrogates, op2_cotraining, op3_toxicity, op4_packing, op5_decision_list, op6_simhash, op7_token_file, op8_mixing, op9_substring_dedup, op10_exact_dedup, op11_warc, op12_collocations, op13_alignment)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op9_substring_dedup": substring_dedup.ORACLE, "op10_exact_dedup": exact_dedup.ORACLE, "op11_warc": warc.ORACLE, "op12_collocations": collocations.ORACLE}
