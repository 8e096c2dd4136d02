"""Names every query of this subpackage and, where SQL can express it, its DuckDB twin."""

from __future__ import annotations

from . import q_chat, q_jaccard, q_suffix_dedup, q_url_filters
from .q_chat import op9_chat_formatting
from .q_fingerprints import op8_document_fingerprints
from .q_jaccard import op3_ngram_jaccard_join
from .q_media import op10_media_columns
from .q_mixing import op1_mixing
from .q_packing import op2_packing
from .q_quality import op4_quality_classifier
from .q_suffix_dedup import op6_suffix_dedup
from .q_token_counts import op5_token_counts
from .q_url_filters import op7_url_filters


def queries():
    return {
        "op1_mixing": op1_mixing,
        "op2_packing": op2_packing,
        "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
        "op4_quality_classifier": op4_quality_classifier,
        "op5_token_counts": op5_token_counts,
        "op6_suffix_dedup": op6_suffix_dedup,
        "op7_url_filters": op7_url_filters,
        "op8_document_fingerprints": op8_document_fingerprints,
        "op9_chat_formatting": op9_chat_formatting,
        "op10_media_columns": op10_media_columns,
    }


def oracle_sql():
    return {
        "op3_ngram_jaccard_join": q_jaccard.ORACLE,
        "op6_suffix_dedup": q_suffix_dedup.ORACLE,
        "op7_url_filters": q_url_filters.ORACLE,
        "op9_chat_formatting": q_chat.ORACLE,
    }
