"""Registry of the subpackage: one query per operator, and its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from loanlens.llm import (conversation_repair, conversation_sql, embedding_dedup, fingerprints, html_extraction,
                          language_id, license_scan, line_dedup, near_dedup, packing, prefix_trie, sentencepieces, token_counts,
                          toxicity)

QUERIES = {
    "op1_toxicity": toxicity.op1,
    "op2_embedding_dedup": embedding_dedup.op2,
    "op3_html_extraction": html_extraction.op3,
    "op4_fingerprints": fingerprints.op4,
    "op5_best_fit_packing": packing.op5,
    "op6_token_counts": token_counts.op6,
    "op7_near_dedup": near_dedup.op7,
    "op8_line_dedup": line_dedup.op8,
    "op9_sentencepieces": sentencepieces.op9,
    "op10_license_scan": license_scan.op10,
    "op11_conversation_repair": conversation_repair.op11,
    "op12_language_id": language_id.op12,
    "op13_prefix_trie": prefix_trie.op13,
}

ORACLE_SQL = {
    "op2_embedding_dedup": embedding_dedup.OP2_SQL,
    "op7_near_dedup": near_dedup.OP7_SQL,
    "op8_line_dedup": line_dedup.OP8_SQL,
    "op10_license_scan": license_scan.OP10_SQL,
    "op11_conversation_repair": conversation_sql.OP11_SQL,
    "op13_prefix_trie": conversation_sql.OP13_SQL,
}
