"""The queries of the corpus operators and their SQL twins."""

from __future__ import annotations

from newsloom.llm import decontaminate, fingerprints, html_extract, mixing, ngram_join, quality, secrets_scan, sharding, sql, token_counts, url_filters


def queries() -> dict:
    return {
        "op1_ngram_jaccard_join": ngram_join.op1,
        "op2_url_filters": url_filters.op2,
        "op3_benchmark_decontamination": decontaminate.op3,
        "op4_secret_scans": secrets_scan.op4,
        "op5_document_fingerprints": fingerprints.op5,
        "op6_quality_classifier": quality.op6,
        "op7_sharding": sharding.op7,
        "op8_token_counts": token_counts.op8,
        "op9_mixing": mixing.op9,
        "op10_html_extraction": html_extract.op10,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_ngram_jaccard_join": sql.NGRAM_JOIN,
        "op2_url_filters": url_filters.SQL,
        "op3_benchmark_decontamination": sql.DECONTAMINATION,
    }
