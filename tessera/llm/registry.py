"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from tessera.llm import fingerprint, language, lines, packing, pieces, pii, simhash, suffix, tokens, topk


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_output": tokens.op1_token_output,
        "op2_language_id": language.op2_language_id,
        "op3_line_dedup": lines.op3_line_dedup,
        "op4_simhash": simhash.op4_simhash,
        "op5_exact_topk": topk.op5_exact_topk,
        "op6_best_fit_packing": packing.op6_best_fit_packing,
        "op7_fingerprint": fingerprint.op7_fingerprint,
        "op8_suffix_dedup": suffix.op8_suffix_dedup,
        "op9_pii": pii.op9_pii,
        "op10_sentencepiece": pieces.op10_sentencepiece,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_line_dedup": lines.OP3_SQL,
        "op5_exact_topk": topk.OP5_SQL,
    }
