"""Queries and oracle SQL of this subpackage, one entry per operator and the pipeline."""

from __future__ import annotations

from lisible.llm import (chat_format, decontaminate, language_id, lm_score, near_dup, periodic_runs, pieces, pii, quality_rules, sharding, toxicity,
                         url_filter, vector_codes)

QUERIES = {
    "op1_sharding": sharding.op1_sharding,
    "op2_language_id": language_id.op2_language_id,
    "op3_chat_formatting": chat_format.op3_chat_formatting,
    "op4_near_dup": near_dup.op4_near_dup,
    "op5_url_filters": url_filter.op5_url_filters,
    "op6_pii": pii.op6_pii,
    "op7_decontamination": decontaminate.op7_decontamination,
    "op8_sentencepiece": pieces.op8_sentencepiece,
    "op9_quality_rules": quality_rules.op9_quality_rules,
    "op10_lm_scoring": lm_score.op10_lm_scoring,
    "op11_vector_codes": vector_codes.op11_vector_codes,
    "op12_periodic_runs": periodic_runs.op12_periodic_runs,
    "op13_toxicity": toxicity.op13_toxicity,
}

ORACLES = {
    "op3_chat_formatting": chat_format.ORACLE,
    "op4_near_dup": near_dup.ORACLE,
    "op7_decontamination": decontaminate.ORACLE,
    "op9_quality_rules": quality_rules.ORACLE,
    "op11_vector_codes": vector_codes.ORACLE,
}
