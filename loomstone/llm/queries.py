"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from loomstone.llm import alignment, centroids, decontamination, jaccard, language_id, lm_scoring, main_text, mixing, nearest, pii, quality, substring_dedup, token_counts

QUERIES = {
    "op1_quality_classifier": quality.op1_quality_classifier,
    "op2_mixing": mixing.op2_mixing,
    "op3_substring_dedup": substring_dedup.op3_substring_dedup,
    "op4_personal_data": pii.op4_personal_data,
    "op5_decontamination": decontamination.op5_decontamination,
    "op6_nearest_neighbours": nearest.op6_nearest_neighbours,
    "op7_token_counts": token_counts.op7_token_counts,
    "op8_language_id": language_id.op8_language_id,
    "op9_lm_scoring": lm_scoring.op9_lm_scoring,
    "op10_ngram_jaccard_join": jaccard.op10_ngram_jaccard_join,
    "op11_tokenizer_alignment": alignment.op11_tokenizer_alignment,
    "op12_main_text": main_text.op12_main_text,
    "op13_centroid_clustering": centroids.op13_centroid_clustering,
}
SQL: dict[str, str] = {
    "op2_mixing": mixing.SQL,
    "op3_substring_dedup": substring_dedup.SQL,
    "op5_decontamination": decontamination.SQL,
    "op10_ngram_jaccard_join": jaccard.SQL,
    "op13_centroid_clustering": centroids.SQL,
}
