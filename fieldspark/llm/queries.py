"""The queries of this subpackage and the SQL twins of those that SQL can express."""

from __future__ import annotations

from fieldspark.llm import byte_bpe, fingerprints, lexical, line_dedup, lm_scoring, ngram_jaccard, packing, quality_lm, quality_rules, spelling, substring_dedup, topk, toxicity

QUERIES = {
    "op1_ngram_jaccard": ngram_jaccard.op1_ngram_jaccard,
    "op2_byte_bpe": byte_bpe.op2_byte_bpe,
    "op3_topk": topk.op3_topk,
    "op4_substring_dedup": substring_dedup.op4_substring_dedup,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_packing": packing.op6_packing,
    "op7_lm_scoring": lm_scoring.op7_lm_scoring,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_quality_rules": quality_rules.op9_quality_rules,
    "op10_quality_classifier": quality_lm.op10_quality_classifier,
    "op11_spelling_variants": spelling.op11_spelling_variants,
    "op12_fingerprints": fingerprints.op12_fingerprints,
    "op13_lexical_search": lexical.op13_lexical_search,
}

ORACLE_SQL = {
    "op1_ngram_jaccard": ngram_jaccard.ORACLE_SQL,
    "op3_topk": topk.ORACLE_SQL,
    "op4_substring_dedup": substring_dedup.ORACLE_SQL,
    "op5_line_dedup": line_dedup.ORACLE_SQL,
    "op9_quality_rules": quality_rules.ORACLE_SQL,
    "op11_spelling_variants": spelling.ORACLE_SQL,
    "op13_lexical_search": lexical.ORACLE_SQL,
}
