"""Registered queries and oracle SQL of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, embedding_dedup, html_extract, license_scan, lm_scoring, ngram_join, packing, quality_cnn, substring_dedup, suffix_dedup
from .oracle import SQL


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            lm_scoring.op1_lm_scoring,
            packing.op2_hierarchical_packing,
            decontamination.op3_benchmark_decontamination,
            html_extract.op4_html_extraction,
            quality_cnn.op5_quality_classifier,
            embedding_dedup.op6_embedding_near_dedup,
            substring_dedup.op7_substring_dedup,
            suffix_dedup.op8_suffix_array_dedup,
            ngram_join.op9_ngram_jaccard_join,
            license_scan.op10_license_scan,
        )
    }


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
