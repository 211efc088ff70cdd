"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from sheetweave.llm import (bpe, centroids, decontamination, exact_dedup, html_text, jaccard, language_id, line_dedup,
                            substring_dedup, token_counts, token_files, warc, whitening)

QUERIES = {
    "op1_token_counts": token_counts.op1_token_counts,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_token_files": token_files.op3_token_files,
    "op4_html_text": html_text.op4_html_text,
    "op5_substring_dedup": substring_dedup.op5_substring_dedup,
    "op6_ngram_jaccard": jaccard.op6_ngram_jaccard,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_decontamination": decontamination.op8_decontamination,
    "op9_language_id": language_id.op9_language_id,
    "op10_bpe": bpe.op10_bpe,
    "op11_centroids": centroids.op11_centroids,
    "op12_whitening": whitening.op12_whitening,
    "op13_warc": warc.op13_warc,
}
ORACLE = {
    "op2_exact_dedup": exact_dedup.ORACLE,
    "op5_substring_dedup": substring_dedup.ORACLE,
    "op6_ngram_jaccard": jaccard.ORACLE,
    "op7_line_dedup": line_dedup.ORACLE,
    "op11_centroids": centroids.ORACLE,
    "op13_warc": warc.ORACLE,
}
