"""The corpus operators' queries and their DuckDB SQL."""

from __future__ import annotations

from glyphmill.llm import (
    alignment,
    byte_bpe,
    cap_filters,
    extendible_shards,
    language_id,
    packing,
    piece_bpe,
    prefix_trie,
    quality_rules,
    quote_links,
    sanitise,
    secret_scan,
    simhash,
)

QUERIES = {
    "op1_language_id": language_id.query,
    "op2_packing": packing.query,
    "op3_quality_rules": quality_rules.query,
    "op4_byte_bpe": byte_bpe.query,
    "op5_simhash": simhash.query,
    "op6_sanitise": sanitise.query,
    "op7_extendible_shards": extendible_shards.query,
    "op8_quote_links": quote_links.query,
    "op9_secret_scan": secret_scan.query,
    "op10_cap_filters": cap_filters.query,
    "op11_alignment": alignment.query,
    "op12_prefix_trie": prefix_trie.query,
    "op13_piece_bpe": piece_bpe.query,
}

ORACLES = {
    "op3_quality_rules": quality_rules.SQL,
    "op7_extendible_shards": extendible_shards.SQL,
    "op8_quote_links": quote_links.SQL,
    "op10_cap_filters": cap_filters.SQL,
    "op12_prefix_trie": prefix_trie.SQL,
}
