"""The registered queries of the numbered operators."""

from __future__ import annotations

from . import embedding_dedup, inner_products, language_model, lexical_search, line_dedup, mixing, packing, simhash, substring_dedup, token_alignment, token_counts, toxicity, url_filter

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_url_filter": url_filter.op2_url_filter,
    "op3_substring_dedup": substring_dedup.op3_substring_dedup,
    "op4_token_counts": token_counts.op4_token_counts,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_packing": packing.op6_packing,
    "op7_source_mixing": mixing.op7_source_mixing,
    "op8_embedding_near_dedup": embedding_dedup.op8_embedding_near_dedup,
    "op9_exact_top_k": inner_products.op9_exact_top_k,
    "op10_simhash_near_dedup": simhash.op10_simhash_near_dedup,
    "op11_lexical_search": lexical_search.op11_lexical_search,
    "op12_lm_scoring": language_model.op12_lm_scoring,
    "op13_token_alignment": token_alignment.op13_token_alignment,
}
ORACLES = {
    "op2_url_filter": url_filter.OP2_SQL,
    "op3_substring_dedup": substring_dedup.OP3_SQL,
    "op5_line_dedup": line_dedup.OP5_SQL,
    "op7_source_mixing": mixing.OP7_SQL,
    "op8_embedding_near_dedup": embedding_dedup.OP8_SQL,
    "op9_exact_top_k": inner_products.OP9_SQL,
    "op11_lexical_search": lexical_search.OP11_SQL,
}
