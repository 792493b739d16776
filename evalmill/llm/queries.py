"""Queries of the training-data operators, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from evalmill.llm import (
    convtrie, decontam, fingerprint, html, langid, license, packing, periodic, secrets, simhash, suffix, tokenout,
    toxicity,
)
from evalmill.llm.common import documents


def _over_documents(operator: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": _over_documents(langid.op1_language_id),
    "op2_decontamination": lambda spark, sf_dir: decontam.op2_decontamination(
        documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    ),
    "op3_simhash": _over_documents(simhash.op3_simhash),
    "op4_license_scan": _over_documents(license.op4_license_scan),
    "op5_best_fit_packing": _over_documents(packing.op5_best_fit_packing),
    "op6_fingerprints": _over_documents(fingerprint.op6_fingerprints),
    "op7_html_extraction": lambda spark, sf_dir: html.op7_html_extraction(
        spark.read.parquet(f"{sf_dir}/pages.parquet")
    ),
    "op8_suffix_dedup": _over_documents(suffix.op8_suffix_dedup),
    "op9_secret_scan": _over_documents(secrets.op9_secret_scan),
    "op10_token_files": _over_documents(tokenout.op10_token_files),
    "op11_toxicity": lambda spark, sf_dir: toxicity.op11_toxicity(
        documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    ),
    "op12_periodic_runs": _over_documents(periodic.op12_periodic_runs),
    "op13_conversation_trie": lambda spark, sf_dir: convtrie.op13_conversation_trie(
        spark.read.parquet(f"{sf_dir}/conversations.parquet")
    ),
}

ORACLE: dict[str, str] = {"op2_decontamination": decontam.ORACLE, "op13_conversation_trie": convtrie.ORACLE}
