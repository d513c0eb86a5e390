"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from homestead.llm import decontam, exact_dedup, html_text, jaccard, language, lattice, negatives, packing, quality, substring, suffix, templates, turns

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_packing": packing.op2_packing,
    "op3_decontamination": decontam.op3_decontamination,
    "op4_quality": quality.op4_quality,
    "op5_html_text": html_text.op5_html_text,
    "op6_substring_dedup": substring.op6_substring_dedup,
    "op7_suffix_dedup": suffix.op7_suffix_dedup,
    "op8_lm_scoring": lattice.op8_lm_scoring,
    "op9_line_templates": templates.op9_line_templates,
    "op10_jaccard_join": jaccard.op10_jaccard_join,
    "op11_hard_negatives": negatives.op11_hard_negatives,
    "op12_turn_repair": turns.op12_turn_repair,
    "op13_language": language.op13_language,
}

SQL = {
    "op1_exact_dedup": exact_dedup.SQL,
    "op6_substring_dedup": substring.SQL,
    "op9_line_templates": templates.SQL,
    "op10_jaccard_join": jaccard.SQL,
    "op11_hard_negatives": negatives.SQL,
    "op12_turn_repair": turns.SQL,
}
