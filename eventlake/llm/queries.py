"""The queries of the text operators, and SQL for those that SQL can express."""

from __future__ import annotations

from . import html, jaccard, media, mixing, packing, pii, quality, shards, suffixes, toxicity

QUERIES = {f.__name__: f for f in (html.op1_html_extraction, toxicity.op2_toxicity, shards.op3_token_shards, pii.op4_personal_data, packing.op5_best_fit_packing, quality.op6_quality_rules, suffixes.op7_suffix_dedup, jaccard.op8_ngram_jaccard, media.op9_media_columns, mixing.op10_mix_sources)}
ORACLES = {"op8_ngram_jaccard": jaccard.ORACLE, "op10_mix_sources": mixing.ORACLE}
