"""The queries of this package and their SQL."""

from __future__ import annotations

from millrace.llm import decontamination, jaccard_join, langid, lm_scoring, mixing, quality, sharding, token_output, toxicity, url_filters

QUERIES = {
    "op1_sharding": sharding.op1_sharding,
    "op2_lm_scoring": lm_scoring.op2_lm_scoring,
    "op3_decontamination": decontamination.op3_decontamination,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_token_output": token_output.op5_token_output,
    "op6_quality": quality.op6_quality,
    "op7_url_filters": url_filters.op7_url_filters,
    "op8_jaccard_join": jaccard_join.op8_jaccard_join,
    "op9_langid": langid.op9_langid,
    "op10_mixing": mixing.op10_mixing,
}

ORACLES = {
    "op3_decontamination": decontamination.OP3_SQL,
    "op7_url_filters": url_filters.OP7_SQL,
    "op10_mixing": mixing.OP10_SQL,
}
