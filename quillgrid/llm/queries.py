"""The registered queries of this subpackage and their DuckDB oracles."""

from __future__ import annotations

from . import decontam, fingerprint, html_extract, language, mixing, ngram_join, quality, token_file, toxicity, url_filter

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_fingerprint": fingerprint.op2_fingerprint,
    "op3_ngram_join": ngram_join.op3_ngram_join,
    "op4_mix": mixing.op4_mix,
    "op5_html_extract": html_extract.op5_html_extract,
    "op6_language": language.op6_language,
    "op7_quality": quality.op7_quality,
    "op8_decontaminate": decontam.op8_decontaminate,
    "op9_token_file": token_file.op9_token_file,
    "op10_url_filter": url_filter.op10_url_filter,
}

SQL = {
    "op8_decontaminate": decontam.OP8_SQL,
    "op10_url_filter": url_filter.OP10_SQL,
}
