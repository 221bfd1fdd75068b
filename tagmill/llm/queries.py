"""The queries of this subpackage: each applies an operator with production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tagmill.llm import decontaminate, langid, licenses, neardup, pieces, quality, secrets, sharding, telephony, tokens
from tagmill.llm.common import table


def _docs(query: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: query(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secret_scan": _docs(secrets.secrets_query),
        "op2_wavelet_tokens": _docs(tokens.token_query),
        "op3_co_training": lambda spark, sf_dir: quality.quality_query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
        "op4_patience_licenses": _docs(licenses.license_query),
        "op5_decontamination": lambda spark, sf_dir: decontaminate.decontamination_query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")),
        "op6_language_id": _docs(langid.langid_query),
        "op7_bounded_ring": _docs(sharding.sharding_query),
        "op8_telephony": _docs(telephony.telephony_query),
        "op9_superminhash": _docs(neardup.neardup_query),
        "op10_merge_dropout": _docs(pieces.pieces_query),
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_decontamination": decontaminate.SQL}
