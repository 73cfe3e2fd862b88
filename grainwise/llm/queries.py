"""The corpus queries, by name, and their SQL where there is one."""

from __future__ import annotations

import corpus_pipeline

from . import bpe, embedding_dedup, exact_dedup, mixing, simhash, substring_dedup, token_counts, token_files, toxicity, unit_dedup

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_unit_dedup": unit_dedup.op1_unit_dedup,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_token_files": token_files.op3_token_files,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_bpe": bpe.op5_bpe,
    "op6_token_counts": token_counts.op6_token_counts,
    "op7_embedding_dedup": embedding_dedup.op7_embedding_dedup,
    "op8_substring_dedup": substring_dedup.op8_substring_dedup,
    "op9_simhash": simhash.op9_simhash,
    "op10_source_mix": mixing.op10_source_mix,
}

ORACLE_SQL = ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}) | {
    "op4_exact_dedup": exact_dedup.ORACLE,
    "op7_embedding_dedup": embedding_dedup.ORACLE,
}
