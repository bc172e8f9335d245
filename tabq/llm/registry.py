"""Queries of this subpackage, and their SQL where SQL can say the same."""

from __future__ import annotations

from . import decontamination, exact_dedup, jaccard_join, line_dedup, lm_scoring, mixing, pii, quality, sharding, toxicity


def queries() -> dict:
    return {
        "op1_decontamination": decontamination.op1_decontamination,
        "op2_bloom_lm": lm_scoring.op2_bloom_lm,
        "op3_line_spread": line_dedup.op3_line_spread,
        "op4_weak_pii": pii.op4_weak_pii,
        "op5_lexicon_toxicity": toxicity.op5_lexicon_toxicity,
        "op6_bradley_terry_quality": quality.op6_bradley_terry_quality,
        "op7_exact_dedup": exact_dedup.op7_exact_dedup,
        "op8_metric_join": jaccard_join.op8_metric_join,
        "op9_hypergeometric_mix": mixing.op9_hypergeometric_mix,
        "op10_rendezvous_sharding": sharding.op10_rendezvous_sharding,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_line_spread": line_dedup.ORACLE, "op7_exact_dedup": exact_dedup.ORACLE, "op8_metric_join": jaccard_join.ORACLE}
