"""The queries of this package and, where SQL can express them, their SQL."""

from __future__ import annotations

from plinth.llm import (
    decontamination,
    kneser_ney,
    license_scan,
    packing,
    quality_rules,
    sharding,
    simhash_golay,
    substring_dedup,
    token_counts,
    url_filter,
)


def queries() -> dict:
    return {
        "op1_packing": packing.op1_packing,
        "op2_kneser_ney": kneser_ney.op2_kneser_ney,
        "op3_license_scan": license_scan.op3_license_scan,
        "op4_simhash_golay": simhash_golay.op4_simhash_golay,
        "op5_url_filter": url_filter.op5_url_filter,
        "op6_substring_dedup": substring_dedup.op6_substring_dedup,
        "op7_sharding": sharding.op7_sharding,
        "op8_decontamination": decontamination.op8_decontamination,
        "op9_quality_rules": quality_rules.op9_quality_rules,
        "op10_token_counts": token_counts.op10_token_counts,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op5_url_filter": url_filter.ORACLE,
        "op6_substring_dedup": substring_dedup.ORACLE,
        "op8_decontamination": decontamination.ORACLE,
    }
