"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, divergence, exact_dedup, expiring, fingerprints, html_text, mixing, near_dedup, quality, sharding, tokens, toxicity, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": mixing.op1_mixing,
    "op2_token_counts": tokens.op2_token_counts,
    "op3_decontamination": decontaminate.op3_decontamination,
    "op4_fingerprints": fingerprints.op4_fingerprints,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_url_filter": urls.op6_url_filter,
    "op7_near_dedup": near_dedup.op7_near_dedup,
    "op8_quality": quality.op8_quality,
    "op9_html_extraction": html_text.op9_html_extraction,
    "op10_sharding": sharding.op10_sharding,
    "op11_source_divergence": divergence.op11_source_divergence,
    "op12_exact_dedup": exact_dedup.op12_exact_dedup,
    "op13_expiring_dedup": expiring.op13_expiring_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op3_decontamination": decontaminate.OP3_SQL,
    "op7_near_dedup": near_dedup.OP7_SQL,
    "op11_source_divergence": divergence.op11_source_divergence,
    "op11_source_divergence": divergence.OP11_SQL,
    "op12_exact_dedup": exact_dedup.OP12_SQL,
}
