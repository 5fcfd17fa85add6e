"""Registered queries of this subpackage and, where SQL can express them, the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessaprobe.llm.conversation_repair import op11_conversation_repair, op11_sql
from tessaprobe.llm.decontamination import op2_benchmark_decontamination
from tessaprobe.llm.html_extraction import op8_html_extraction
from tessaprobe.llm.language_model import op1_language_model
from tessaprobe.llm.license_scan import op3_license_scan, op3_sql
from tessaprobe.llm.near_dup import op7_minhash_near_dedup
from tessaprobe.llm.packing import op5_packing
from tessaprobe.llm.quality_classifier import op10_quality_classifier
from tessaprobe.llm.quality_rules import op6_quality_rules, op6_sql
from tessaprobe.llm.simhash_dedup import op13_simhash_near_dedup
from tessaprobe.llm.spelling import op12_spelling_variants, op12_sql
from tessaprobe.llm.toxicity import op4_toxicity
from tessaprobe.llm.url_reputation import op9_sql, op9_url_reputation


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_model": op1_language_model,
        "op2_benchmark_decontamination": op2_benchmark_decontamination,
        "op3_license_scan": op3_license_scan,
        "op4_toxicity": op4_toxicity,
        "op5_packing": op5_packing,
        "op6_quality_rules": op6_quality_rules,
        "op7_minhash_near_dedup": op7_minhash_near_dedup,
        "op8_html_extraction": op8_html_extraction,
        "op9_url_reputation": op9_url_reputation,
        "op10_quality_classifier": op10_quality_classifier,
        "op11_conversation_repair": op11_conversation_repair,
        "op12_spelling_variants": op12_spelling_variants,
        "op13_simhash_near_dedup": op13_simhash_near_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_license_scan": op3_sql(),
        "op6_quality_rules": op6_sql(),
        "op9_url_reputation": op9_sql(),
        "op11_conversation_repair": op11_sql(),
        "op12_spelling_variants": op12_sql(),
    }
