"""Queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from sparkloom.llm import bpe, exact, near, packing, paragraphs, quality, scoring, substrings, tokenfiles, warc

QUERIES = {
    "op1_bpe_round_trip": bpe.op1_bpe_round_trip,
    "op2_near_dedup": near.op2_near_dedup,
    "op3_substring_removal": substrings.op3_substring_removal,
    "op4_paragraph_dedup": paragraphs.op4_paragraph_dedup,
    "op5_best_fit_packing": packing.op5_best_fit_packing,
    "op7_recurrent_scores": scoring.op7_recurrent_scores,
    "op8_token_files": tokenfiles.op8_token_files,
    "op9_quality_rules": quality.op9_quality_rules,
    "op10_warc": warc.op10_warc,
    "op6_exact_dedup": exact.op6_exact_dedup,
}
SQL = {"op10_warc": warc.OP10_SQL, "op6_exact_dedup": exact.OP6_SQL}
