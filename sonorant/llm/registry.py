"""The queries of this subpackage and their DuckDB equivalents, for __spark_entry__.py."""

from __future__ import annotations

import corpus_pipeline
from sonorant.llm import base_queries, exact_dedup, kneser_ney, license_scan, ngram_join, packing, pii, quality_rules, source_mix, suffix_dedup, toxicity

QUERIES = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_pii": pii.op2_pii,
    "op3_ngram_join": ngram_join.op3_ngram_join,
    "op4_source_mix": source_mix.op4_source_mix,
    "op5_license_scan": license_scan.op5_license_scan,
    "op6_packing": packing.op6_packing,
    "op7_quality_classifier": kneser_ney.op7_quality_classifier,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_suffix_dedup": suffix_dedup.op10_suffix_dedup,
    "pipeline": corpus_pipeline.run,
} | base_queries.QUERIES

#: The others have no form in SQL (trained models, seeded draws, tokenizers) and are held against plain Python in tests/llm;
#: the base columns of four of them have queries of their own.
ORACLES = {"op3_ngram_join": ngram_join.ORACLE, "op8_exact_dedup": exact_dedup.ORACLE, "op10_suffix_dedup": suffix_dedup.ORACLE} | base_queries.ORACLES
