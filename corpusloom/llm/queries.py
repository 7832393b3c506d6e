"""The queries of this package, by name, and their SQL."""

from __future__ import annotations

from corpusloom.llm import chat_format, decontaminate, exact_dedup, html_extract, language_id, line_dedup, near_dup, packing, quality, substring_dedup

QUERIES = {
    "op1_best_fit_packing": packing.op1_best_fit_packing,
    "op2_language_id": language_id.op2_language_id,
    "op3_minhash_near_dedup": near_dup.op3_minhash_near_dedup,
    "op4_quality_classifier": quality.op4_quality_classifier,
    "op5_benchmark_decontamination": decontaminate.op5_benchmark_decontamination,
    "op6_html_extraction": html_extract.op6_html_extraction,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_chat_formatting": chat_format.op8_chat_formatting,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_substring_dedup": substring_dedup.op10_substring_dedup,
}

SQL = {
    "op5_benchmark_decontamination": decontaminate.OP5_SQL,
    "op7_line_dedup": line_dedup.OP7_SQL,
    "op8_chat_formatting": chat_format.OP8_SQL,
    "op9_exact_dedup": exact_dedup.OP9_SQL,
    "op10_substring_dedup": substring_dedup.OP10_SQL,
}
