"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from lexiflow.llm import bpe, exact_dedup, fill_in_middle, html_extraction, mixing, quality_classifier, quality_rules, sharding, simhash, suffix_dedup, toxicity, url_filter, vector_codes

QUERIES = {
    "op1_nnpu_toxicity": toxicity.op1_nnpu_toxicity,
    "op2_byte_bpe": bpe.op2_byte_bpe,
    "op3_mcd_outliers": quality_rules.op3_mcd_outliers,
    "op4_cotraining": quality_classifier.op4_cotraining,
    "op5_tag_path_ratios": html_extraction.op5_tag_path_ratios,
    "op6_url_words": url_filter.op6_url_words,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_simhash": simhash.op8_simhash,
    "op9_pivotal_mixing": mixing.op9_pivotal_mixing,
    "op10_ring_sharding": sharding.op10_ring_sharding,
    "op11_fill_in_middle": fill_in_middle.op11_fill_in_middle,
    "op12_ball_codes": vector_codes.op12_ball_codes,
    "op13_suffix_dedup": suffix_dedup.op13_suffix_dedup,
}

#: The other operators have no SQL; tests compare them with brute force or held-out labels.
ORACLE_SQL = {
    "op7_exact_dedup": exact_dedup.OP7_SQL,
}
