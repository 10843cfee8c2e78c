"""The operators' queries and, where SQL can express one, its DuckDB SQL."""

from __future__ import annotations

from . import bpe, chat, decontamination, language_id, licenses, line_dedup, lm, near_dedup, prefix_trie, quality, repair, sharding, toxicity


def queries() -> dict:
    return {
        "op1_sharding": sharding.op1_sharding,
        "op2_toxicity": toxicity.op2_toxicity,
        "op3_language": language_id.op3_language,
        "op4_bpe": bpe.op4_bpe,
        "op5_quality": quality.op5_quality,
        "op6_near_dedup": near_dedup.op6_near_dedup,
        "op7_line_dedup": line_dedup.op7_line_dedup,
        "op8_licenses": licenses.op8_licenses,
        "op9_decontamination": decontamination.op9_decontamination,
        "op10_chat": chat.op10_chat,
        "op11_repair": repair.op11_repair,
        "op12_lm": lm.op12_lm,
        "op13_prefix_trie": prefix_trie.op13_prefix_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_sharding": sharding.OP1_SQL,
        "op5_quality": quality.OP5_SQL,
        "op7_line_dedup": line_dedup.OP7_SQL,
        "op8_licenses": licenses.OP8_SQL,
        "op10_chat": chat.OP10_SQL,
        "op11_repair": repair.OP11_SQL,
        "op12_lm": lm.OP12_SQL,
        "op13_prefix_trie": prefix_trie.OP13_SQL,
    }
