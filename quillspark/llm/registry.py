"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from . import decontaminate, language, ngram_join, packing, quality, substring_dedup, tokens, toxicity, url_filter, warc

QUERIES = {
    "op1_token_files": tokens.op1_token_files,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_packing": packing.op4_packing,
    "op5_quality_rules": quality.op5_quality_rules,
    "op6_language": language.op6_language,
    "op7_substring_dedup": substring_dedup.op7_substring_dedup,
    "op8_url_filter": url_filter.op8_url_filter,
    "op9_warc": warc.op9_warc,
    "op10_ngram_jaccard": ngram_join.op10_ngram_jaccard,
}

SQL = {
    "op3_decontaminate": decontaminate.OP3_SQL,
    "op5_quality_rules": quality.OP5_SQL,
    "op9_warc": warc.OP9_SQL,
    "op10_ngram_jaccard": ngram_join.OP10_SQL,
}
