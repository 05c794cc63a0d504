"""The queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from quotary.llm import decontaminate, hamming, html_blocks, importance, mixing, ngram_join, quality, secrets, sharding, substrings, tokens, topk, variants

QUERIES = {
    "op1_sharding": sharding.op1_sharding,
    "op2_ngram_jaccard": ngram_join.op2_ngram_jaccard,
    "op3_quality": quality.op3_quality,
    "op4_mixing": mixing.op4_mixing,
    "op5_substring_dedup": substrings.op5_substring_dedup,
    "op6_topk": topk.op6_topk,
    "op7_secrets": secrets.op7_secrets,
    "op8_html": html_blocks.op8_html,
    "op9_decontamination": decontaminate.op9_decontamination,
    "op10_token_counts": tokens.op10_token_counts,
    "op11_neighbours": hamming.op11_neighbours,
    "op12_variants": variants.op12_variants,
    "op13_importance": importance.op13_importance,
}
SQL = {
    "op1_sharding": sharding.OP1_SQL,
    "op4_mixing": mixing.OP4_SQL,
    "op6_topk": topk.OP6_SQL,
    "op7_secrets": secrets.OP7_SQL,
    "op12_variants": variants.OP12_SQL,
    "op13_importance": importance.OP13_SQL,
}
