"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from keepsake.llm import byte_pairs, collocations, fill_in_middle, fingerprints, language_id, licenses, line_dedup, mixing, near_dedup, quality, substring_dedup, token_files, topk


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_fingerprints": fingerprints.op1_fingerprints,
        "op2_language_id": language_id.op2_language_id,
        "op3_line_dedup": line_dedup.op3_line_dedup,
        "op4_license_scan": licenses.op4_license_scan,
        "op5_token_files": token_files.op5_token_files,
        "op6_mix_sources": mixing.op6_mix_sources,
        "op7_byte_bpe": byte_pairs.op7_byte_bpe,
        "op8_top_k": topk.op8_top_k,
        "op9_quality": quality.op9_quality,
        "op10_near_dedup": near_dedup.op10_near_dedup,
        "op11_substring_dedup": substring_dedup.op11_substring_dedup,
        "op12_collocations": collocations.op12_collocations,
        "op13_fill_in_middle": fill_in_middle.op13_fill_in_middle,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_line_dedup": line_dedup.OP3_SQL,
        "op4_license_scan": licenses.OP4_SQL,
        "op8_top_k": topk.OP8_SQL,
        "op11_substring_dedup": substring_dedup.OP11_SQL,
        "op12_collocations": collocations.OP12_SQL,
        "op13_fill_in_middle": fill_in_middle.OP13_SQL,
    }
