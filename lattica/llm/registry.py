"""Queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from lattica.llm import decontaminate, language_id, lm_score, mixing, pii, quality, quality_rules, simhash, substring_dedup, toxicity

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_lm_score": lm_score.op2_lm_score,
    "op3_language_id": language_id.op3_language_id,
    "op4_simhash": simhash.op4_simhash,
    "op5_substring_dedup": substring_dedup.op5_substring_dedup,
    "op6_source_mixing": mixing.op6_source_mixing,
    "op7_pii": pii.op7_pii,
    "op8_quality_rules": quality_rules.op8_quality_rules,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_toxicity": toxicity.op10_toxicity,
}

ORACLES = {
    "op6_source_mixing": mixing.SQL,
    "op8_quality_rules": quality_rules.SQL,
}
