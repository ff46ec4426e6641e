"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import chat_format, exact_spans, mixing, near_dups, nearest, pieces, quality_model, quality_rules, toxicity, url_filters

QUERIES = {
    "op1_url_filters": url_filters.op1_url_filters,
    "op2_quality_model": quality_model.op2_quality_model,
    "op3_exact_spans": exact_spans.op3_exact_spans,
    "op4_chat_format": chat_format.op4_chat_format,
    "op5_mixing": mixing.op5_mixing,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_pieces": pieces.op7_pieces,
    "op8_nearest": nearest.op8_nearest,
    "op9_near_dups": near_dups.op9_near_dups,
    "op10_quality_rules": quality_rules.op10_quality_rules,
}
ORACLE_SQL = {
    "op1_url_filters": url_filters.SQL,
    "op4_chat_format": chat_format.SQL,
    "op5_mixing": mixing.SQL,
}
