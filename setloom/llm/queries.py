"""The queries of this package and, where SQL can express one, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from setloom.llm import byte_bpe, chat_format, decontaminate, jaccard_join, license_scan, pii, quality_classifier, quality_rules, suffix_dedup, suffix_tree_lm

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": license_scan.op1_license_scan,
    "op2_quality_classifier": quality_classifier.op2_quality_classifier,
    "op3_chat_format": chat_format.op3_chat_format,
    "op4_lm_score": suffix_tree_lm.op4_lm_score,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_pii": pii.op6_pii,
    "op7_suffix_dedup": suffix_dedup.op7_suffix_dedup,
    "op8_quality_rules": quality_rules.op8_quality_rules,
    "op9_jaccard_join": jaccard_join.op9_jaccard_join,
    "op10_byte_bpe": byte_bpe.op10_byte_bpe,
}

ORACLES: dict[str, str] = {
    "op1_license_scan": license_scan.SQL,
    "op3_chat_format": chat_format.SQL,
    "op7_suffix_dedup": suffix_dedup.SQL,
    "op8_quality_rules": quality_rules.SQL,
    "op9_jaccard_join": jaccard_join.SQL,
}
