"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codeharbor.llm import ann, decontaminate, fim, licenses, lm_mixing, merkle, packing, pieces, pii, simhash, suffix_dedup, toxicity, url_filter
from codeharbor.llm.common import load
from codeharbor.llm.oracles import ORACLE  # noqa: F401


SECRET_SETTING = "spark.codeharbor.surrogates.key"
SECRET = "only-for-trials"


def secret(spark: SparkSession) -> str:
    """The key of the surrogates: a setting of the session; where it is unset, one for trials that is no secret."""
    return spark.conf.get(SECRET_SETTING, SECRET)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(licenses.as_files(load(spark, sf_dir, "documents")))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(load(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(load(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op6_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = pii.replace(load(spark, sf_dir, "documents").select("doc_id", "text"), secret(spark))
    return made.withColumnRenamed("_n_entities", "n_entities")


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.report(load(spark, sf_dir, "embeddings"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = load(spark, sf_dir, "pages")
    return url_filter.judge(pages, url_filter.listed(pages, url_filter.LISTED_SITES), url_filter.RULES)


def op9_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_mixing.score(load(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.report(load(spark, sf_dir, "documents"), packing.vocabulary_text())


def op11_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.report(load(spark, sf_dir, "documents"), pieces.model_bytes())


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.report(load(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.report(load(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_license_scan, op2_simhash, op3_suffix_dedup, op4_decontamination, op5_toxicity, op6_pii_surrogates, op7_nearest_neighbours, op8_url_filter, op9_context_mixing, op10_packing,
    op11_piece_encoding, op12_fill_in_middle, op13_merkle_manifest,
)}
