"""The queries of this subpackage, and their SQL where SQL can state the result."""

from __future__ import annotations

from loamgraph.llm import (
    byte_bpe,
    chat_quotes,
    curve_packing,
    html_extraction,
    language_id,
    media_sniffing,
    quality_rules,
    simhash_dedup,
    substring_dedup,
    toxicity,
)

MODULES = [substring_dedup, quality_rules, toxicity, byte_bpe, html_extraction, chat_quotes, language_id, curve_packing, media_sniffing, simhash_dedup]
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE = {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
