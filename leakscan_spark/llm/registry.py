"""The registered queries of the training-data operators and their SQL checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import prepare
from . import (
    centroids, decontaminate, language, line_dedup, mixing, near_dedup, pii, quality_model, quality_rules, repair, secret_ledger,
    suffix_dedup, tokens,
)

QUERIES = (
    near_dedup.op1_minhash_near_dedup, secret_ledger.op2_secret_scan, line_dedup.op3_line_dedup,
    decontaminate.op4_decontamination, quality_rules.op5_quality_rules, mixing.op6_mixing, pii.op7_pii,
    language.op8_language_id, suffix_dedup.op9_suffix_dedup, quality_model.op10_quality_classifier,
    centroids.op11_centroid_clustering, repair.op12_conversation_repair, tokens.op13_token_counts,
)
SQL = {"op3_line_dedup": line_dedup.SQL, "op6_mixing": mixing.SQL, "op11_centroid_clustering": centroids.SQL,
       "op12_conversation_repair": repair.SQL}


def registry() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bound(fn: Callable) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: fn(prepare(spark), sf_dir)

    return {fn.__name__: bound(fn) for fn in QUERIES}
