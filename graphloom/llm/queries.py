"""Registered queries of this package, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from graphloom.llm import op1_jaccard, op2_urls, op3_audio, op4_tokens, op5_shards, op6_pieces, op7_html, op8_langid, op9_leaks, op10_secrets, op11_quality, op12_turns, op13_spelling

QUERIES = {
    "op1_ngram_jaccard_join": op1_jaccard.query,
    "op2_url_filters": op2_urls.query,
    "op3_media_columns": op3_audio.query,
    "op4_token_counts": op4_tokens.query,
    "op5_sharding": op5_shards.query,
    "op6_sentencepiece": op6_pieces.query,
    "op7_html_extraction": op7_html.query,
    "op8_language_id": op8_langid.query,
    "op9_decontamination": op9_leaks.query,
    "op10_secret_scans": op10_secrets.query,
    "op11_quality_classifier": op11_quality.query,
    "op12_conversation_repair": op12_turns.query,
    "op13_spelling_variants": op13_spelling.query,
}

ORACLE_SQL = {
    "op2_url_filters": op2_urls.ORACLE,
    "op5_sharding": op5_shards.ORACLE,
    "op9_decontamination": op9_leaks.ORACLE,
    "op10_secret_scans": op10_secrets.ORACLE,
    "op12_conversation_repair": op12_turns.ORACLE,
    "op13_spelling_variants": op13_spelling.ORACLE,
}
