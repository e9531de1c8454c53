"""The registered queries of this package, and their SQL where SQL can express them."""

from __future__ import annotations

from tessera.llm import decontaminate, langid, maxent_lm, media, ngram_join, quality, secrets, sentencepieces, suffixes, urlfilter

QUERIES = {
    "op1_secret_scans": secrets.op1_secret_scans,
    "op3_benchmark_decontamination": decontaminate.op3_benchmark_decontamination,
    "op7_url_filters": urlfilter.op7_url_filters,
    "op10_suffix_array_dedup": suffixes.op10_suffix_array_dedup,
    "op2_ngram_jaccard_join": ngram_join.op2_ngram_jaccard_join,
    "op9_lm_scoring": maxent_lm.op9_lm_scoring,
    "op5_sentencepiece": sentencepieces.op5_sentencepiece,
    "op6_language_id": langid.op6_language_id,
    "op8_quality_classifier": quality.op8_quality_classifier,
    "op4_media_columns": media.op4_media_columns,
}
ORACLE: dict[str, str] = {
    "op3_benchmark_decontamination": decontaminate.OP3_SQL,
    "op7_url_filters": urlfilter.OP7_SQL,
}
