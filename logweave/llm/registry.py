"""Queries and SQL of this subpackage."""

from __future__ import annotations

from . import bpe, chat, decontaminate, jaccard, katz, pii, quality_rules, quality_trees, substring, toxicity


def queries():
    return {
        "op1_ngram_jaccard_join": jaccard.op1_ngram_jaccard_join,
        "op2_quality_rules": quality_rules.op2_quality_rules,
        "op3_substring_dedup": substring.op3_substring_dedup,
        "op4_byte_bpe": bpe.op4_byte_bpe,
        "op5_katz_backoff": katz.op5_katz_backoff,
        "op6_pii": pii.op6_pii,
        "op7_chat_formatting": chat.op7_chat_formatting,
        "op8_toxicity_crf": toxicity.op8_toxicity_crf,
        "op9_decontamination": decontaminate.op9_decontamination,
        "op10_quality_trees": quality_trees.op10_quality_trees,
    }


def oracle_sql():
    return {"op1_ngram_jaccard_join": jaccard.OP1_SQL, "op2_quality_rules": quality_rules.OP2_SQL, "op3_substring_dedup": substring.OP3_SQL, "op7_chat_formatting": chat.OP7_SQL}
