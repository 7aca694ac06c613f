"""Queries over the driver's tables for every operator of this subpackage, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from relplan.sources import shared

from . import kdtree, lbl, licenses, minhash, mixing, pu_quality, substrings, wacz, winnow


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.groups(_table(spark, sf_dir, "documents"))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"), substrings.BYTES)
    return found.selectExpr("rest.doc_id", "n_units AS n_bytes", "n_removed", "n_spans", "kept_sha256")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wacz.round_trip(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lbl.score(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"), substrings.WORDS)
    return found.selectExpr("rest.doc_id", "n_units AS n_words", "n_removed", "kept_sha256")


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdtree.top_k(_table(spark, sf_dir, "embeddings"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pu_quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        shared.ship(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_minhash_dedup, op2_suffix_array_dedup, op3_warc, op4_lm_scoring, op5_license_scan, op6_substring_dedup, op7_topk, op8_decontamination, op9_quality_classifier, op10_mixing]
    return {name: _shipped(f) for name, f in [*((f.__name__, f) for f in own), ("pipeline", corpus_pipeline.run)]}


def oracle_sql() -> dict[str, str]:
    found = {"op1_minhash_dedup": minhash.ORACLE, "op2_suffix_array_dedup": substrings.BYTES_ORACLE, "op6_substring_dedup": substrings.WORDS_ORACLE, "op3_warc": wacz.ORACLE, "op5_license_scan": licenses.oracle(), "op7_topk": kdtree.ORACLE, "op8_decontamination": winnow.ORACLE, "op10_mixing": mixing.ORACLE}
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
