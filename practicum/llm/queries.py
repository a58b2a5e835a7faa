"""The registered queries of the text operators and their SQL where SQL can say the same."""

from __future__ import annotations

import corpus_pipeline

from . import chat_format, decontaminate, language_id, line_dedup, mixing, ngram_join, quality, substring_dedup, token_output, url_filter

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_ngram_join": ngram_join.op2_ngram_join,
    "op3_chat_format": chat_format.op3_chat_format,
    "op4_language_id": language_id.op4_language_id,
    "op5_url_filter": url_filter.op5_url_filter,
    "op6_quality_rules": quality.op6_quality_rules,
    "op7_substring_dedup": substring_dedup.op7_substring_dedup,
    "op8_token_output": token_output.op8_token_output,
    "op9_mixing": mixing.op9_mixing,
    "op10_line_dedup": line_dedup.op10_line_dedup,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {
    "op1_decontaminate": decontaminate.ORACLE,
    "op3_chat_format": chat_format.ORACLE,
    "op5_url_filter": url_filter.ORACLE,
    "op6_quality_rules": quality.ORACLE,
    "op9_mixing": mixing.ORACLE,
}
