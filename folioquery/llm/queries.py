"""Queries and SQL of the corpus operators, by registered name."""

from . import context_mixing, decontam, html_text, mixing, near_dedup, quality, repeats, resampling, suffixes, token_counts, token_records, toxicity, whitening

QUERIES = {
    "op1_token_records": token_records.op1_token_records,
    "op2_html_text": html_text.op2_html_text,
    "op3_setsketch_dedup": near_dedup.op3_setsketch_dedup,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_context_mixing": context_mixing.op5_context_mixing,
    "op6_wu_manber": decontam.op6_wu_manber,
    "op7_decision_list": quality.op7_decision_list,
    "op8_sainte_lague": mixing.op8_sainte_lague,
    "op9_substring_index": repeats.op9_substring_index,
    "op10_token_rollup": token_counts.op10_token_rollup,
    "op11_whitening": whitening.op11_whitening,
    "op12_suffix_array": suffixes.op12_suffix_array,
    "op13_importance_resampling": resampling.op13_importance_resampling,
}
ORACLES = {
    "op3_setsketch_dedup": near_dedup.ORACLE_SQL,
    "op6_wu_manber": decontam.ORACLE_SQL,
    "op8_sainte_lague": mixing.ORACLE_SQL,
    "op9_substring_index": repeats.ORACLE_SQL,
    "op10_token_rollup": token_counts.ORACLE_SQL,
    "op12_suffix_array": suffixes.ORACLE_SQL,
    "op13_importance_resampling": resampling.ORACLE_SQL,
}
