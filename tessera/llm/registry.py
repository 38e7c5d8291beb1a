"""Registered queries of the corpus operators and the SQL they must agree with, where SQL can express them."""

from __future__ import annotations

from tessera.llm import decontaminate, exact_dedup, html_text, jaccard_join, language_model, licenses, near_dedup, packing, quality, substring_dedup, token_files, vector_codes, whitening

_QUERIES = {
    "op1_near_dedup": (near_dedup.op1_near_dedup, near_dedup.ORACLE),
    "op2_quality": (quality.op2_quality, None),
    "op3_substring_dedup": (substring_dedup.op3_substring_dedup, None),
    "op4_exact_dedup": (exact_dedup.op4_exact_dedup, exact_dedup.ORACLE),
    "op5_html_text": (html_text.op5_html_text, None),
    "op6_language_model": (language_model.op6_language_model, None),
    "op7_decontaminate": (decontaminate.op7_decontaminate, decontaminate.ORACLE),
    "op8_license_scan": (licenses.op8_license_scan, licenses.ORACLE),
    "op9_token_files": (token_files.op9_token_files, None),
    "op10_packing": (packing.op10_packing, None),
    "op11_vector_codes": (vector_codes.op11_vector_codes, vector_codes.ORACLE),
    "op12_whitening": (whitening.op12_whitening, None),
    "op13_jaccard_join": (jaccard_join.op13_jaccard_join, jaccard_join.ORACLE),
}


def queries() -> dict:
    return {name: query for name, (query, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _QUERIES.items() if sql}
