"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from granary.llm import op1_sorted_shards, op11_pack_patterns, op12_filter_audit, op13_fill_in_middle, op2_url_filter, op3_html_text, op4_mixing, op10_maxent_lm, op5_decontaminate, op6_jaccard_join, op7_quality_rules, op8_language_id, op9_token_counts
from granary.llm.oracles import ORACLES

__all__ = ["ORACLES", "QUERIES"]

QUERIES = {
    "op1_sorted_shards": op1_sorted_shards.query,
    "op10_maxent_lm": op10_maxent_lm.query,
    "op11_pack_patterns": op11_pack_patterns.query,
    "op12_filter_audit": op12_filter_audit.query,
    "op13_fill_in_middle": op13_fill_in_middle.query,
    "op2_url_filter": op2_url_filter.query,
    "op3_html_text": op3_html_text.query,
    "op4_mixing": op4_mixing.query,
    "op5_decontaminate": op5_decontaminate.query,
    "op6_jaccard_join": op6_jaccard_join.query,
    "op7_quality_rules": op7_quality_rules.query,
    "op8_language_id": op8_language_id.query,
    "op9_token_counts": op9_token_counts.query,
}
