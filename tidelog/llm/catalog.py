"""Queries of these operators and, where SQL can express one, its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from tidelog.llm import preference_format
from tidelog.llm.decontaminate import op4_latent_retrieval
from tidelog.llm.quality_classifier import op8_fourier_ridge
from tidelog.llm.quality_rules import op7_robust_outliers
from tidelog.llm.source_mixing import op6_soft_membership
from tidelog.llm.simhash import op3_covering_simhash
from tidelog.llm.substring_dedup import op2_sentence_spans
from tidelog.llm.token_counts import op1_offset_tokens
from tidelog.llm.toxicity import op10_chain_crf
from tidelog.llm.url_filter import op5_url_template_tree


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_offset_tokens": op1_offset_tokens,
        "op2_sentence_spans": op2_sentence_spans,
        "op3_covering_simhash": op3_covering_simhash,
        "op4_latent_retrieval": op4_latent_retrieval,
        "op5_url_template_tree": op5_url_template_tree,
        "op6_soft_membership": op6_soft_membership,
        "op7_robust_outliers": op7_robust_outliers,
        "op8_fourier_ridge": op8_fourier_ridge,
        "op9_preference_pairs": preference_format.op9_preference_pairs,
        "op10_chain_crf": op10_chain_crf,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    known = {"op9_preference_pairs": preference_format.ORACLE, "pipeline": corpus_pipeline.ORACLE_SQL}
    return {name: sql for name, sql in known.items() if sql}
