"""The queries of this subpackage and their SQL, by the names that the entry file registers."""

from __future__ import annotations

from . import decontaminate, html_text, knn, mix, quality, secrets, simhash, substring, suffix, warc

QUERIES = {
    "op1_substring_dedup": substring.query,
    "op2_mix_sources": mix.query,
    "op3_knn": knn.query,
    "op4_secrets": secrets.query,
    "op5_html_text": html_text.query,
    "op6_decontaminate": decontaminate.query,
    "op7_quality": quality.query,
    "op8_simhash": simhash.query,
    "op9_warc": warc.query,
    "op10_suffix_dedup": suffix.query,
}

SQL = {
    "op1_substring_dedup": substring.SQL,
    "op2_mix_sources": mix.SQL,
    "op3_knn": knn.SQL,
    "op6_decontaminate": decontaminate.SQL,
    "op9_warc": warc.SQL,
    "op10_suffix_dedup": suffix.SQL,
}
