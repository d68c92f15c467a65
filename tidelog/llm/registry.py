"""Queries of the corpus operators and, where SQL can express them, their oracle SQL."""

from __future__ import annotations

from tidelog.llm import (
    block_neighbours,
    decontamination,
    html_extract,
    language_id,
    license_scan,
    mixing,
    quality,
    simhash_dedup,
    substring_dedup,
    warc,
)

MODULES = {
    "op1_language_id": language_id,
    "op2_simhash_near_dedup": simhash_dedup,
    "op3_html_extraction": html_extract,
    "op4_quality_classifier": quality,
    "op5_block_neighbours": block_neighbours,
    "op6_warc": warc,
    "op7_substring_dedup": substring_dedup,
    "op8_benchmark_decontamination": decontamination,
    "op9_mixing": mixing,
    "op10_license_scan": license_scan,
}


def queries():
    return {name: getattr(module, name) for name, module in MODULES.items()}


def oracle_sql():
    return {name: module.ORACLE_SQL for name, module in MODULES.items() if getattr(module, "ORACLE_SQL", None)}
