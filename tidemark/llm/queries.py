"""Registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from tidemark.llm import decontaminate, exact_dedup, language_id, near_dedup, pfair, phrases, quality_ranking, quality_rules, source_divergence, substring_dedup, token_files, toxicity, url_cascade


def queries():
    return {
        "op1_language_id": language_id.query,
        "op2_quality_ranking": quality_ranking.query,
        "op3_toxicity": toxicity.query,
        "op4_pfair_mixing": pfair.query,
        "op5_url_bloom_cascade": url_cascade.query,
        "op6_near_dedup": near_dedup.query,
        "op7_substring_dedup": substring_dedup.query,
        "op8_decontaminate": decontaminate.query,
        "op9_token_files": token_files.query,
        "op10_quality_rules": quality_rules.query,
        "op11_exact_dedup": exact_dedup.query,
        "op12_phrases": phrases.query,
        "op13_source_divergence": source_divergence.query,
    }


def oracle_sql():
    return {
        "op5_url_bloom_cascade": url_cascade.oracle(),
        "op10_quality_rules": quality_rules.oracle(),
        "op11_exact_dedup": exact_dedup.oracle(),
        "op12_phrases": phrases.oracle(),
        "op13_source_divergence": source_divergence.oracle(),
    }
