"""Queries and SQL of the llm operators."""

from __future__ import annotations

from ledgerloom.llm import bpe, conversation_repair, jaccard_join, language_id, line_dedup, mixing, quality, text_search, token_files, token_rollup, toxicity, vector_codes, vector_search

QUERIES = {
    "op1_mix_sources": mixing.op1_mix_sources,
    "op2_text_search": text_search.op2_text_search,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_byte_bpe": bpe.op4_byte_bpe,
    "op5_vector_search": vector_search.op5_vector_search,
    "op6_ngram_jaccard": jaccard_join.op6_ngram_jaccard,
    "op7_token_counts": token_rollup.op7_token_counts,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op9_language_id": language_id.op9_language_id,
    "op10_quality": quality.op10_quality,
    "op11_token_files": token_files.op11_token_files,
    "op12_conversation_repair": conversation_repair.op12_conversation_repair,
    "op13_vector_codes": vector_codes.op13_vector_codes,
}
SQL = {"op1_mix_sources": mixing.SQL, "op2_text_search": text_search.SQL, "op8_line_dedup": line_dedup.SQL, "op13_vector_codes": vector_codes.SQL}
