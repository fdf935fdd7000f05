"""The queries of this package for __spark_entry__.py, and their SQL where SQL can express them."""

from __future__ import annotations

from . import decontaminate, embedding_dedup, html_text, license_scan, line_dedup, mixing, ngram_join, oracles, quality, secret_scan, substring_dedup

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_secret_scan": secret_scan.op2_secret_scan,
    "op3_source_mix": mixing.op3_source_mix,
    "op4_html_text": html_text.op4_html_text,
    "op5_ngram_jaccard": ngram_join.op5_ngram_jaccard,
    "op6_license_scan": license_scan.op6_license_scan,
    "op7_quality": quality.op7_quality,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op9_embedding_dedup": embedding_dedup.op9_embedding_dedup,
    "op10_substring_dedup": substring_dedup.op10_substring_dedup,
}

SQL = {
    "op3_source_mix": mixing.OP3_SQL,
    "op5_ngram_jaccard": oracles.OP5_SQL,
    "op6_license_scan": license_scan.OP6_SQL,
    "op8_line_dedup": line_dedup.OP8_SQL,
    "op9_embedding_dedup": oracles.OP9_SQL,
    "op10_substring_dedup": oracles.OP10_SQL,
}
