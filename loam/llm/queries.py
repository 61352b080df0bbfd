"""The registered queries of the training-data operators and their DuckDB equivalents."""

from __future__ import annotations

from loam.llm import bpe, chat, fingerprint, langid, line_dedup, near_dedup, ngram_lm, packing, resampling, spelling, suffix_dedup, token_store, topk

QUERIES = {
    "op1_token_store": token_store.op1_token_store,
    "op2_near_dedup": near_dedup.op2_near_dedup,
    "op3_lm_scoring": ngram_lm.op3_lm_scoring,
    "op4_language_id": langid.op4_language_id,
    "op5_packing": packing.op5_packing,
    "op6_chat_formatting": chat.op6_chat_formatting,
    "op7_topk": topk.op7_topk,
    "op8_bpe": bpe.op8_bpe,
    "op9_fingerprints": fingerprint.op9_fingerprints,
    "op10_line_dedup": line_dedup.op10_line_dedup,
    "op11_spelling_variants": spelling.op11_spelling_variants,
    "op12_resampling": resampling.op12_resampling,
    "op13_suffix_dedup": suffix_dedup.op13_suffix_dedup,
}
ORACLE_SQL = {"op7_topk": topk.SQL, "op2_near_dedup": near_dedup.SQL, "op6_chat_formatting": chat.SQL, "op10_line_dedup": line_dedup.SQL, "op11_spelling_variants": spelling.SQL, "op12_resampling": resampling.SQL, "op13_suffix_dedup": suffix_dedup.SQL}
