"""Queries of this subpackage, and their SQL where SQL can express them."""

from foliant.llm import bestfit, decontaminate, extract, katz, matrices, neardup, quality, suffixes, toxicity, warc

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_quality_rules": quality.op2_quality_rules,
    "op3_near_duplicates": neardup.op3_near_duplicates,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_warc": warc.op5_warc,
    "op6_suffix_dedup": suffixes.op6_suffix_dedup,
    "op7_token_matrices": matrices.op7_token_matrices,
    "op8_best_fit": bestfit.op8_best_fit,
    "op9_katz": katz.op9_katz,
    "op10_extract": extract.op10_extract,
}

ORACLE_SQL = {
    "op2_quality_rules": quality.SQL,
    "op4_decontaminate": decontaminate.SQL,
    "op5_warc": warc.SQL,
}
