"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import op1_ngram_jaccard, op3_decontamination, op4_url_filter, op5_embedding_neardup, op9_lm_scoring, op11_spelling_variants, op12_centroid_clustering
from .op2_toxicity import op2_toxicity
from .op6_html_extraction import op6_html_extraction
from .op7_token_counts import op7_token_counts
from .op8_mixing import op8_mixing
from .op10_license_scan import op10_license_scan
from .op13_language_id import op13_language_id


def queries():
    return {
        "op1_ngram_jaccard": op1_ngram_jaccard.op1_ngram_jaccard,
        "op2_toxicity": op2_toxicity,
        "op3_decontamination": op3_decontamination.op3_decontamination,
        "op4_url_filter": op4_url_filter.op4_url_filter,
        "op5_embedding_neardup": op5_embedding_neardup.op5_embedding_neardup,
        "op6_html_extraction": op6_html_extraction,
        "op7_token_counts": op7_token_counts,
        "op8_mixing": op8_mixing,
        "op9_lm_scoring": op9_lm_scoring.op9_lm_scoring,
        "op10_license_scan": op10_license_scan,
        "op11_spelling_variants": op11_spelling_variants.op11_spelling_variants,
        "op12_centroid_clustering": op12_centroid_clustering.op12_centroid_clustering,
        "op13_language_id": op13_language_id,
    }


def oracle_sql():
    return {
        "op1_ngram_jaccard": op1_ngram_jaccard.ORACLE,
        "op3_decontamination": op3_decontamination.ORACLE,
        "op4_url_filter": op4_url_filter.ORACLE,
        "op5_embedding_neardup": op5_embedding_neardup.ORACLE,
        "op9_lm_scoring": op9_lm_scoring.ORACLE,
        "op11_spelling_variants": op11_spelling_variants.ORACLE,
        "op12_centroid_clustering": op12_centroid_clustering.ORACLE,
    }
