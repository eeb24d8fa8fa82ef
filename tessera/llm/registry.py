"""Queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from . import decontamination, divergence, language, lines, media, mixing, neardup, packing, prefixes, quality, sharding, tokens, urls

QUERIES = {
    "op1_near_duplicates": neardup.op1_near_duplicates,
    "op2_token_histogram": tokens.op2_token_histogram,
    "op3_url_filter": urls.op3_url_filter,
    "op4_source_mix": mixing.op4_source_mix,
    "op5_line_dedup": lines.op5_line_dedup,
    "op6_decontaminate": decontamination.op6_decontaminate,
    "op7_byte_shards": sharding.op7_byte_shards,
    "op8_image_copies": media.op8_image_copies,
    "op9_quality": quality.op9_quality,
    "op10_language_id": language.op10_language_id,
    "op11_source_divergence": divergence.op11_source_divergence,
    "op12_prefix_trie": prefixes.op12_prefix_trie,
    "op13_packed_sequences": packing.op13_packed_sequences,
}

SQL = {
    "op1_near_duplicates": neardup.OP1_SQL,
    "op3_url_filter": urls.OP3_SQL,
    "op4_source_mix": mixing.OP4_SQL,
    "op5_line_dedup": lines.OP5_SQL,
    "op6_decontaminate": decontamination.OP6_SQL,
    "op11_source_divergence": divergence.OP11_SQL,
    "op12_prefix_trie": prefixes.OP12_SQL,
}
