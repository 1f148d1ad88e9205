"""All queries of the subpackage, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.llm import op1_sharding, op2_line_dedup, op3_license, op4_mixing, op5_secrets, op6_url_filter, op7_ann, op8_simhash, op9_decontaminate, op10_quality, op11_importance, op12_whitening, op13_ngram_join

MODULES = (op1_sharding, op2_line_dedup, op3_license, op4_mixing, op5_secrets, op6_url_filter, op7_ann, op8_simhash, op9_decontaminate, op10_quality, op11_importance, op12_whitening, op13_ngram_join)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in MODULES for k, q in m.SQL.items()}
